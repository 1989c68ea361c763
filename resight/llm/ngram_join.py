"""Exact n-gram Jaccard join by the pigeonhole principle over a partition of the token universe.

Sets lie in size bands so wide that a partner of no greater size is in the same band or the one below. Two
sets of a band that reach the similarity differ in at most H tokens. A hash deals the universe of
tokens into m segments, a number of the band's own; each segment i has a threshold t_i of 0 (its tokens must be equal) or 1 (one
token may be missing on one side). If the t_i + 1 add up to H + 1, similar sets meet in some
segment: a set emits a key for its tokens in every segment and, where t_i = 1, one for each
of these without one token. How many segments get the one-deletion neighbourhood is a matter of
cost: many small segments need few keys but coincide by chance, fewer and larger ones need a key
for each token. The allocation weighs both by the band's number of sets, which is counted over all data.

Equal sets are one set from the start. Sets that share a key (not both by a deletion) are tied to the key's first set, so a
key costs a row for each holder; what hangs together is a family, and the links within
families are found exactly (``families``).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from resight.llm.families import distinct_sets, resolve, sets_of, sums
from resight.llm.words import NOT_SPACE, U, mix, narrow
from resight.session import settle, settle_lookup

#: What a chance candidate costs against an emitted key.
CANDIDATE_COST = 30.0
PIECE = 1 << 18


class Plan(NamedTuple):
    edges: np.ndarray  # least size of each band, and one above the greatest
    segments: np.ndarray  # of each band, 0 where only equal sets can match
    loose: np.ndarray  # how many of them, the first ones, allow a deletion


def band_edges(largest: int, num: int, den: int) -> np.ndarray:
    """Least sizes of the bands up to ``largest``, and the one after."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * den // num + 1))
    return np.array(edges, dtype=np.int64)


def difference(a, b, num: int, den: int):
    """The most tokens in which similar sets of a and b tokens differ."""
    return (den - num) * (a + b) // (den + num)


def allocate(edges: np.ndarray, counts: np.ndarray, num: int, den: int) -> Plan:
    """For each band the segments and how many of them allow a deletion, at the least expected cost."""
    segments, loose = np.zeros(len(edges) - 1, np.int64), np.zeros(len(edges) - 1, np.int64)
    for c in range(len(edges) - 1):
        top = int(edges[c + 1]) - 1
        most = int(difference(top, top * den // num, num, den))
        if most == 0:
            continue
        n = float(counts[c : c + 2].sum())
        a = np.arange((most + 1) // 2 + 1)
        m = most + 1 - a
        s = float(edges[c]) / m
        rows = n * (m + a * s)
        chance = CANDIDATE_COST * n * n / 2 * np.exp(-2 * s) * ((m - a) + a * (1 + 2 * s))
        best = int(np.argmin(rows + chance))
        segments[c], loose[c] = m[best], a[best]
    return Plan(edges, segments, loose)


def _identities(shingle, word):
    """Rows (id, text) -> (id, n, s1, s2): size and 128-bit identity of each row's set."""

    def run(batches):
        for b in batches:
            got = [(len(s), *sums(s)) for s in sets_of(b, shingle, word)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([x[i] for x in got], pa.int64()) for i in range(3))], ["id", "n", "s1", "s2"])

    return run


def keys_of(sets: list[np.ndarray], plan: Plan, num: int, den: int):
    """(key, set, role) of some sets; role is 1 for a deletion, plus 2 where the key is meant for the band below."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    flat, who = np.concatenate([*sets, np.zeros(0, U)]).astype(U), np.repeat(np.arange(len(sets)), n)
    band = np.searchsorted(plan.edges, n, side="right") - 1
    value = mix(flat)
    place = mix(flat ^ U(0x3C6EF372FE94F82B))
    for below in (0, 1):
        c = band - below
        use = (c >= 0) & (n > 0)
        if below:
            use &= num * n <= (plan.edges[np.maximum(band, 0)] - 1) * den
        m = np.where(use, plan.segments[np.maximum(c, 0)], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        take = np.flatnonzero(m[who])
        if not len(take):
            continue
        w, v = who[take], value[take]
        segment = (place[take] % m[w].astype(U)).astype(np.int64)
        at = base[w] + segment
        low = np.bincount(at, (v & U(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(U)
        content = low + (np.bincount(at, (v >> U(32)).astype(np.float64), base[-1]).astype(U) << U(32))
        owner = np.repeat(np.arange(len(sets)), m)
        number = np.arange(base[-1]) - base[owner]
        tag = mix(c[owner].astype(U) * U(0x9E3779B97F4A7C15) + number.astype(U))
        yield mix(content + tag), owner, np.full(len(owner), 2 * below, np.int8)
        cut = np.flatnonzero(segment < plan.loose[c[w]])
        if len(cut):
            yield mix(content[at[cut]] - v[cut] + tag[at[cut]]), w[cut], np.full(len(cut), 2 * below + 1, np.int8)


def _keys(shared, shingle, word, num, den):
    """Rows (rep, s1, text) -> rows (key, rep, role); of an id's rows the one with the sum s1 counts."""

    def run(batches):
        plan = shared.value
        for b in batches:
            rep, want = b.column("rep").to_numpy(), b.column("s1").to_numpy()
            held, names, size = [], [], 0
            for i, s in enumerate(sets_of(b, shingle, word)):
                if sums(s)[0] == want[i]:
                    held.append(s)
                    names.append(rep[i])
                    size += len(s)
                if size > PIECE:
                    yield from emit(plan, held, names)
                    held, names, size = [], [], 0
            yield from emit(plan, held, names)

    def emit(plan, held, names):
        names = np.array(names, dtype=np.int64)
        for key, who, role in keys_of(held, plan, num, den):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(names[who]), pa.array(role)], ["key", "rep", "role"])

    return run


def candidate_ties(rows: DataFrame) -> DataFrame:
    """Ties (a, b) that connect all sets which share a key (key, rep, role), one of them in the key's own band and one of them whole."""
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("rep")))
    keys = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.min("rep").alias("least"), F.max("rep").alias("most"), of(0).alias("whole"), of(1).alias("cut"), of(2).alias("above"),
    ).where("n > 1 and least < most and (whole is not null or (cut is not null and above is not null))")
    keys = settle(keys)
    # with two holders the key itself names them
    two = keys.where("n = 2").select(F.col("least").alias("a"), F.col("most").alias("b"))
    many = settle_lookup(keys.where("n > 2").select("key", "whole", "cut", "above"))
    hub = F.coalesce("whole", F.when(F.col("role") == 1, F.col("above")).when(F.col("role") == 2, F.col("cut")))
    more = rows.join(many, "key").select(hub.alias("a"), F.col("rep").alias("b")).where("a <> b")
    # where whole and cut sets of the own band are missing, the least holders of both sides are tied by either rule
    return two.union(more).distinct()


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, num: int = 90, den: int = 100, word=NOT_SPACE,
) -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs.

    component_id is the smallest id reachable over links of Jaccard similarity num / den or more between
    the sets of distinct word shingles (a text of fewer words is one shingle), the row's own included. A null or
    empty text, or one without words, has no set and is linked with nothing. Rows that repeat an id are one
    document, similar to what any of them is similar to; each gives its own n_shingles. A null id is
    linked with nothing and has a null component. Other columns are ignored; an empty table gives no rows.
    """
    slim = narrow(docs, id_col, text_col)
    rows = settle(slim.mapInArrow(_identities(shingle, word), "id long, n long, s1 long, s2 long"))
    same = distinct_sets(rows)
    largest = same.agg(F.max("n")).first()[0] or 0
    edges = band_edges(largest, num, den)
    counts = np.zeros(len(edges), np.int64)
    # a row for each band, that is a few dozen
    bands = same.select(F.expr(f"{len(edges)} - size(filter(array({','.join(str(e) + 'L' for e in edges)}), e -> e > n)) - 1").alias("band"))
    for r in bands.groupBy("band").count().collect():
        counts[r["band"]] = r["count"]
    plan = docs.sparkSession.sparkContext.broadcast(allocate(edges, counts, num, den))

    needed = settle_lookup(same.select("rep", F.col("first").alias("id"), "s1"))
    chosen = slim.join(needed, "id").select("rep", "s1", "text")
    emitted = settle(chosen.mapInArrow(_keys(plan, shingle, word, num, den), "key long, rep long, role byte"))
    return resolve(slim, rows, same, candidate_ties(emitted), shingle, num, den, word)
