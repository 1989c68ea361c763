"""Hard negatives by a vertical (branch-and-bound on decomposed vectors) scan.

Rows are dealt, ordered by label, into shards which store their vectors dimension by dimension, with the
least and greatest value of each. Anchors come in blocks; blocks and shards meet in a join on the shard's
number. For one anchor a shard is read in the order of the anchor's descending magnitudes, a few
dimensions at a time: what is summed so far plus the least and greatest that the remaining dimensions can
give bounds every row's score, and a bitmap keeps the rows that can still count. A row goes when
its bounds fall outside all of the anchor's windows, or below the k-th lower bound of the
rows that are surely inside one. Scores are whole numbers, so the bounds are exact.

The first scan finds each anchor's best rows of its own label (one window without ends, only
shards which hold the label), the second its best rows of other labels in the window that each
of these positives opens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from resight.session import settle

SHARD = 4_096
BLOCK = 256
STEP = 8
_FAR = 1 << 62
RECORD = "n int, ids binary, labels binary, x binary"
FOUND = "anchor_id long, window int, id long, score long"


def _numbers(b: bytes, *shape) -> np.ndarray:
    return np.frombuffer(b, dtype=np.int64).reshape(*shape) if shape else np.frombuffer(b, dtype=np.int64)


def _pack(vertical: bool, size: int, width: int):
    """Rows (id, label, x, low, high) of a partition -> records of up to ``size`` rows; vertical ones hold a dimension at a time."""

    def records(ids, labels, x, low, high):
        for lo in range(0, len(ids), size):
            part = x[lo : lo + size]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(part)], pa.int32()), pa.array([ids[lo : lo + size].tobytes()], pa.binary()), pa.array([labels[lo : lo + size].tobytes()], pa.binary()),
                    pa.array([np.ascontiguousarray(part.T if vertical else part).tobytes()], pa.binary()),
                    pa.array([low[lo : lo + size]], pa.list_(pa.list_(pa.int64()))), pa.array([high[lo : lo + size]], pa.list_(pa.list_(pa.int64()))),
                ],
                ["n", "ids", "labels", "x", "low", "high"],
            )

    def run(batches):
        held = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) >= size:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    def flush(held):
        t = pa.Table.from_batches(held).combine_chunks()
        x = t.column("x").combine_chunks()
        flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, width)
        ids, labels = (t.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        yield from records(ids, labels, flat, t.column("low").to_pylist(), t.column("high").to_pylist())

    return run


def scan(q: np.ndarray, x: np.ndarray, least: np.ndarray, most: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, score) of the ``rows`` of a shard that may be among the k best of one of the windows [low, high]; scores are exact.

    ``x`` holds a dimension at a time; ``least`` and ``most`` are its dimensions' ends.
    """
    order = np.argsort(-np.abs(q), kind="stable")
    ends = np.stack([q * least, q * most])
    under, over = ends.min(0)[order], ends.max(0)[order]
    under, over = (np.append(e[::-1].cumsum()[::-1], 0) for e in (under, over))
    score = np.zeros(len(rows), np.int64)
    for at in range(0, len(q), STEP):
        dims = order[at : at + STEP]
        score += q[dims] @ x[np.ix_(dims, rows)]
        done = min(at + STEP, len(q))
        lower, upper = score + under[done], score + over[done]
        alive = np.zeros(len(rows), bool)
        for a, b in zip(low, high):
            may = (upper >= a) & (lower <= b)
            sure = lower[may & (lower >= a) & (upper <= b)]
            if len(sure) > k:
                may &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
            alive |= may
        if not alive.all():
            rows, score = rows[alive], score[alive]
        if not len(rows):
            break
    return rows, score


def _meet(k: int, width: int, same: bool):
    """Pairs (block, shard) -> each anchor's k best rows of the shard for each of its windows."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                n = r["n"]
                ids, labels, x = _numbers(r["ids"]), _numbers(r["labels"]), _numbers(r["x"], width, n)
                least, most = x.min(1), x.max(1)
                out = []
                anchors = zip(_numbers(r["a_ids"]), _numbers(r["a_labels"]), _numbers(r["a_x"], r["a_n"], width), r["low"], r["high"])
                for a, label, q, low, high in anchors:
                    ask = (labels == label) & (ids != a) if same else labels != label
                    rows, score = scan(q, x, least, most, np.flatnonzero(ask), low, high, k)
                    for w, (lo, hi) in enumerate(zip(low, high)):
                        at = np.flatnonzero((score >= lo) & (score <= hi))
                        at = at[np.lexsort((ids[rows[at]], -score[at]))[:k]]
                        if len(at):
                            out.append((np.full(len(at), a), np.full(len(at), w, np.int32), ids[rows[at]], score[at]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor_id", "window", "id", "score"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _numbered(records: DataFrame, name: str) -> DataFrame:
    """Settled records with a dense number from 0; the window sees one narrow row for a record, that is for thousands of rows."""
    kept = settle(records.withColumn("_at", F.monotonically_increasing_id()))
    order = kept.select("_at", (F.row_number().over(Window.orderBy("_at")) - 1).alias(name))
    return kept.join(order, "_at").drop("_at")


def hard_negatives(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *,
    every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``every`` divides. An anchor's positives are its ``positives`` best
    other rows of the same label; for each come the ``k`` best rows of other labels with low * positive_score
    <= 100 * negative_score <= high * positive_score. Scores are inner products of floor(scale * component), ties go to the
    smaller id; with fewer rows all come back. A row takes no part if its id, label or vector
    is null or a component is null or not finite. Of rows that repeat an id the one with the smallest
    label, then vector, counts. Vectors of different lengths are led to the longest by zeros. Products must stay
    within 64 bits. Other columns are ignored. An anchor without positives, and a negative positive_score, give no rows.
    """
    v = F.col(f"`{vec_col}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").where(finite)
    rows = rows.select("id", F.struct("label", F.transform("v", lambda x: F.floor(x * scale)).alias("x")).alias("r"))
    rows = settle(rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.x"))
    count, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    width = max(width or 1, 1)
    nothing = F.array().cast("array<bigint>")
    rows = rows.select("id", "label", F.slice(F.concat("x", F.array_repeat(F.lit(0).cast("long"), width)), 1, width).alias("x"), nothing.alias("low"), nothing.alias("high"))

    def dealt(df, n, size, vertical):
        parts = max(1, -(-n // size))
        placed = df.repartitionByRange(parts, "label", F.xxhash64("id")) if parts > 1 else df.coalesce(1)
        return placed.mapInArrow(_pack(vertical, size, width), f"{RECORD}, low array<array<long>>, high array<array<long>>")

    shards = settle(_numbered(dealt(rows, count, SHARD, True).drop("low", "high"), "shard"))
    n_shards = shards.count()
    anchors = rows.where(F.col("id") % every == 0)
    n_anchors = anchors.count()

    def labels_of(records, name):
        """The labels that a record holds."""

        def run(batches):
            for b in batches:
                for at, got in zip(b.column(name).to_pylist(), b.column("labels").to_pylist()):
                    u = np.unique(_numbers(got))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), at, np.int32)), pa.array(u)], [name, "label"])

        return records.select(name, "labels").mapInArrow(run, f"{name} int, label long")

    def met(blocks, pairs, most, same):
        named = blocks.select("block", F.col("n").alias("a_n"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("x").alias("a_x"), "low", "high")
        both = pairs.join(named, "block").join(shards, "shard")
        return settle(_first(both.drop("block", "shard").mapInArrow(_meet(most, width, same), FOUND), most))

    ends = [F.array(F.lit(e).cast("long")) for e in (-_FAR, _FAR)]
    blocks = _numbered(dealt(anchors.withColumns({"low": ends[0], "high": ends[1]}), n_anchors, BLOCK, False), "block")
    pairs = labels_of(blocks, "block").join(labels_of(shards, "shard"), "label").select("block", "shard").distinct()
    best = met(blocks, pairs, positives, True).select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    # an anchor's windows in the order of its positives
    opened = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("w"))
    lowest = F.transform("w", lambda w: F.ceil(w["positive_score"].cast("decimal(20,0)") * low / F.lit(100)).cast("long"))
    highest = F.transform("w", lambda w: F.floor(w["positive_score"].cast("decimal(20,0)") * high / F.lit(100)).cast("long"))
    asked = anchors.drop("low", "high").join(opened.select(F.col("anchor_id").alias("id"), lowest.alias("low"), highest.alias("high")), "id")
    blocks = _numbered(dealt(asked.select("id", "label", "x", "low", "high"), n_anchors, BLOCK, False), "block")
    pairs = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(max(n_shards - 1, 0)))).alias("shard"))
    found = met(blocks, pairs, k, False)
    return found.withColumn("place", F.col("window") + 1).join(best, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
