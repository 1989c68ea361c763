"""Toxicity by non-negative positive-unlabelled learning.

Only rows confirmed toxic count as labelled; all training rows together are the unlabelled text,
of which the class prior is toxic. Features are words and the openings of words (stems, whatever their
endings): Spark counts, for every one that a positive row has, in how many positive rows and in
how many of all training rows it occurs, and those whose share among positives is
furthest above, and by more than chance among so many, are kept. A numpy logistic model is then fitted on a
bounded, hashed sample (``POSITIVES`` + ``UNLABELLED`` rows, at most ``FEATURES`` words each) with the
class-prior-corrected risk  prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]),  descending
the negated negative part whenever it falls below zero (by more than a tenth of the prior). Scoring covers all rows and whole texts.

Rows of the held-out fold never give a label or a count. Language, source and id are no inputs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from resight.llm.words import ALNUM, U, chunks, narrow, openings, release, split
from resight.session import settle, settle_lookup

OPENINGS = (4, 5, 6)
FEATURES = 1_024
POSITIVES = 20_000
UNLABELLED = 40_000
#: A feature's gain must exceed the logarithm of the number of features looked at by so much.
MARGIN = 3.0


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes of words and openings
    weights: np.ndarray
    bias: float


def _hashes(c):
    """(hash, row) of every word of a chunk, then of every opening."""
    w = split(c, ALNUM)
    yield w.hash, w.row
    for size in OPENINGS:
        h, at = openings(c, w, size)
        yield h, w.row[at]


def _present(batch, words):
    """(row, feature) of every feature that a row's text has, each once."""
    rows, feats = [], []
    seen = np.zeros(1 << 16, dtype=bool)
    seen[(words >> U(48)).astype(np.int64)] = True
    for c in chunks(batch.column("text")):
        found = []
        for h, row in _hashes(c):
            at = np.flatnonzero(seen[(h >> U(48)).astype(np.int64)])
            if len(at) and len(words):
                f = np.minimum(np.searchsorted(words, h[at]), len(words) - 1)
                ok = words[f] == h[at]
                found.append((row[at[ok]].astype(np.int64) + c.lo) * len(words) + f[ok])
        if found:
            both = np.unique(np.concatenate(found))
            rows.append(both // len(words))
            feats.append(both % len(words))
    none = np.zeros(0, np.int64)
    return np.concatenate([*rows, none]), np.concatenate([*feats, none])


def _row_counts(batches):
    """(feature, n): in how many rows of a chunk a word or opening occurs."""
    for b in batches:
        for c in chunks(b.column("text")):
            h, r = (np.concatenate(x) for x in zip(*_hashes(c)))
            # rows of a chunk are few, so (feature, row) sorts as one number after the features are numbered
            u, which = np.unique(h, return_inverse=True)
            rows = len(c.offsets) - 1
            once = np.unique(which.astype(np.int64) * rows + r)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(once // rows, minlength=len(u)).astype(np.int64))], ["feature", "n"])
            del h, r, u, which, once
    release()


def _features(shared):
    def run(batches):
        words = shared.value
        for b in batches:
            row, f = _present(b, words)
            at = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("positive"), pa.ListArray.from_arrays(at, pa.array(f.astype(np.int32)))], ["positive", "features"])

    return run


def _fit(x_p: list, x_u: list, start: np.ndarray, prior: float, steps: int = 800, rate: float = 0.05, penalty: float = 1e-5, slack: float = 0.1) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with the sigmoid loss, which is bounded, so far-out rows can't upset it."""

    def flat(rows):
        return np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    (fp, rp), (fu, ru) = flat(x_p), flat(x_u)
    n = len(start)
    w, m, v = np.append(start, np.log(prior / (1 - prior))), np.zeros(n + 1), np.zeros(n + 1)

    def gradient(scale_p, scale_u):
        out = (np.bincount(fp, scale_p[rp], minlength=n + 1) + np.bincount(fu, scale_u[ru], minlength=n + 1)).astype(float)
        out[n] = scale_p.sum() + scale_u.sum()
        return out

    for t in range(1, steps + 1):
        gp = np.bincount(rp, w[fp], minlength=len(x_p)) + w[n]
        gu = np.bincount(ru, w[fu], minlength=len(x_u)) + w[n]
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = su.mean() - prior * sp.mean()
        pull, push = -prior * sp * (1 - sp) / len(gp), su * (1 - su) / len(gu)
        g = gradient(2 * pull, push) if negative >= -slack * prior else gradient(-pull, -push)
        g[:n] += penalty * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    # the bias is moved until the mean score of all text is the prior
    g, lo, hi = np.bincount(ru, w[fu], minlength=len(x_u)), -20.0, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 / (1 + np.exp(-g - mid))).mean() < prior else (lo, mid)
    return w[:n], lo


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", *, folds: int = 5) -> Model | None:
    """The model, or None where no training row is confirmed toxic."""
    spark = docs.sparkSession
    fold = F.coalesce(F.crc32(F.col("id").cast("string")) % folds, F.lit(0))
    rows = narrow(docs, id_col, text_col).where(fold != 0)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null")
    known = known.where(fold != 0).groupBy("id").agg(F.max("y").alias("y"))
    prior, some = known.agg(F.avg("y"), F.sum("y")).first()
    if not some:
        return None
    prior = min(max(prior, 1e-4), 0.9)
    toxic = settle_lookup(known.where("y = 1").select("id"))
    positive = rows.join(toxic, "id", "left_semi")

    n_p, n_u = positive.count(), rows.count()
    if not n_p:
        return None
    counted = lambda df: df.select("text").mapInArrow(_row_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    among = settle(counted(positive).withColumnRenamed("n", "p"))
    both = among.join(counted(rows).withColumnRenamed("n", "u"), "feature")
    # the log-likelihood ratio of a feature's count among positives against its share in all text
    share, p = (F.col("u") + 0.5) / (n_u + 1), F.col("p") / n_p
    gain = F.when(p > share, n_p * (p * F.log(p / share) - p + share))
    least = float(np.log(max(among.count(), 1)) + MARGIN)
    top = both.select("feature", share.alias("share"), p.alias("p"), gain.alias("gain")).where(F.col("gain") >= least)
    top = sorted(top.orderBy(F.desc("gain"), "feature").limit(FEATURES).collect(), key=lambda x: x.feature & ((1 << 64) - 1))
    words = np.array([x.feature for x in top], dtype=np.int64).view(U)
    # where the descent starts: each feature's log-odds, with the positives' part taken out of all text
    share, p = (np.array([x[c] for x in top], dtype=float) for c in ("share", "p"))
    start = np.log(p / np.maximum((share - prior * p) / (1 - prior), 0.5 / (n_u + 1)))
    shared = spark.sparkContext.broadcast(words)

    def sample(df, most, total, flag):
        share = min(1.0, most / max(total, 1))
        part = df.where((F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / (1 << 30)) < share) if share < 1 else df
        return part.select("text", F.lit(flag).alias("positive")).mapInArrow(_features(shared), "positive boolean, features array<int>")

    got = sample(positive, POSITIVES, n_p, True).union(sample(rows, UNLABELLED, n_u, False)).collect()
    x_p, x_u = [r.features for r in got if r.positive], [r.features for r in got if not r.positive]
    w, bias = _fit(x_p, x_u, start, prior)
    return Model(words, w, bias)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' ``keep`` columns with (id, score, predicted) of every row; 0 and 0 without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"keep_{c}") for c in keep))
    others = [f for f in slim.schema.fields if f.name.startswith("keep_")]

    def run(batches):
        m = shared.value
        for b in batches:
            g = np.full(b.num_rows, -np.inf)
            if m is not None:
                row, f = _present(b, m.words)
                g = np.bincount(row, m.weights[f], minlength=b.num_rows) + m.bias
            s = 1 / (1 + np.exp(-np.maximum(g, -700)))
            s[~np.isfinite(g)] = 0.0
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *(b.column(f.name) for f in others)], ["id", "score", "predicted", *(f.name for f in others)]
            )

    schema = ", ".join(["id long", "score double", "predicted int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others)])
    out = slim.mapInArrow(run, schema)
    return out.select("id", "score", "predicted", *(F.col(f"`keep_{c}`").alias(c) for c in keep))


def toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", *, folds: int = 5) -> DataFrame:
    """(id, held_out, score, predicted) of every row of docs, trained on the rows outside the held-out fold.

    Null and empty texts have no words and get the score of the bias. A null id counts as held
    out. Labels without id or value are ignored, the highest of several counts; without a
    confirmed toxic training row every score is 0. Repeated rows are scored alike.
    """
    out = score(docs, train(docs, labels, id_col, text_col, label_col, folds=folds), id_col, text_col)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds, F.lit(0)) == 0
    return out.select("id", held.alias("held_out"), "score", "predicted")
