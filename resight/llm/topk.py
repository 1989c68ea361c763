"""Exact inner-product top-k by ball trees, one for each shard of rows, with branch and bound.

Rows are dealt evenly into shards of about ``SHARD``. A shard's rows go into a balanced tree of
balls (centre, radius); centre . q + radius * |q| bounds every inner product in a ball. Queries
come in blocks of ``BLOCK``, which is all that is ever broadcast. A first pass descends to each
query's most promising leaf of each shard; the k-th best of all these scores is then
shared, and the second pass visits the nodes whose bound reaches the better of that score and the
shard's own k-th, best bound first. A shard returns at most k rows for a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from resight.session import settle

SHARD = 4_096
LEAF = 64
BLOCK = 4_096
SCHEMA = "query_id long, vec_id long, score long"


class Tree:
    """Levels of balls over rows which are put in tree order; level j has 2^j nodes of near equal size."""

    def __init__(self, x: np.ndarray):
        order, edges = np.arange(len(x)), np.array([0, len(x)])
        self.edges = [edges]
        while (np.diff(edges) > LEAF).any():
            cut = []
            for a, b in zip(edges[:-1], edges[1:]):
                part = order[a:b]
                if b - a > 1:
                    # halves on the line through two far-apart rows
                    far = x[part][np.argmax(((x[part] - x[part[0]]) ** 2).sum(1))]
                    other = x[part][np.argmax(((x[part] - far) ** 2).sum(1))]
                    order[a:b] = part[np.argsort(x[part] @ (other - far), kind="stable")]
                cut += [a, (a + b) // 2]
            edges = np.array([*cut, len(x)])
            self.edges.append(edges)
        self.order = order
        self.rows = x[order]
        self.balls = []
        for e in self.edges:
            c = np.stack([self.rows[a:b].mean(0) if b > a else np.zeros(x.shape[1]) for a, b in zip(e[:-1], e[1:])])
            r = np.array([np.sqrt(((self.rows[a:b] - m) ** 2).sum(1).max()) if b > a else -np.inf for a, b, m in zip(e[:-1], e[1:], c)])
            self.balls.append((c, r))

    def bounds(self, level: int, nodes: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Upper bound for each (query, node); a little above, for rounding."""
        c, r = self.balls[level]
        b = q @ c[nodes].T + length[:, None] * r[nodes]
        return b + 1e-9 * (1 + np.abs(b))


class Best:
    """Each query's k best (score, id) so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[q], score], axis=1)
        i = np.concatenate([self.id[q], np.broadcast_to(ids, score.shape)], axis=1)
        i = np.where(s == np.iinfo(np.int64).min, np.iinfo(np.int64).max, i)
        if s.shape[1] > 4 * self.k:
            # only rows that reach the k-th score can count; ties all stay for the order by id
            kth = -np.partition(-s.astype(np.float64), self.k - 1, axis=1)[:, self.k - 1 : self.k]
            width = int((s >= kth).sum(1).max())
            if width < s.shape[1]:
                top = np.argsort(-s.astype(np.float64), axis=1, kind="stable")[:, :width]
                s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[q], self.id[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def kth(self) -> np.ndarray:
        return self.score[:, -1]


def _shards(batches):
    ids, rows = [], []
    for b in batches:
        if b.num_rows:
            ids.append(b.column("id").to_numpy(zero_copy_only=False))
            rows.append(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
    return (np.concatenate(ids), np.concatenate(rows)) if ids else (np.zeros(0, np.int64), np.zeros((0, 1)))


def _score(q, rows, exact_float):
    return (q @ rows.T).astype(np.int64) if exact_float else (q.astype(np.int64) @ rows.astype(np.int64).T)


def _search(shared, k, first):
    def run(batches):
        q_ids, q, shared_kth, exact_float = shared.value
        ids, x = _shards(batches)
        if not len(ids):
            return
        best = Best(len(q), k)
        tree = Tree(x)
        ids = ids[tree.order]
        length = np.sqrt((q * q).sum(1))
        leaves = tree.edges[-1]

        def visit(leaf, who):
            a, b = leaves[leaf], leaves[leaf + 1]
            if b > a:
                s = _score(q[who], tree.rows[a:b], exact_float)
                s[ids[a:b][None, :] == q_ids[who][:, None]] = np.iinfo(np.int64).min
                best.add(who, s, ids[a:b])

        if first:
            node = np.zeros(len(q), np.int64)
            for level in range(1, len(tree.edges)):
                pair = [tree.bounds(level, np.arange(len(tree.balls[level][1])), q, length)]
                rows = np.arange(len(q))
                node = np.where(pair[0][rows, 2 * node + 1] > pair[0][rows, 2 * node], 2 * node + 1, 2 * node)
            for leaf in np.unique(node):
                visit(leaf, np.flatnonzero(node == leaf))
        else:
            # down the levels, dropping what cannot reach the shared score; then leaves, best bound first
            alive = np.ones((len(q), 1), bool)
            bound = None
            for level in range(len(tree.edges)):
                if level:
                    alive = np.repeat(alive, 2, axis=1)
                nodes = np.flatnonzero(alive.any(0))
                part = tree.bounds(level, nodes, q, length)
                bound = np.full(alive.shape, -np.inf)
                bound[:, nodes] = np.where(alive[:, nodes], part, -np.inf)
                alive &= bound >= shared_kth[:, None]
            order = np.argsort(-bound, axis=1, kind="stable")
            for j in range(order.shape[1]):
                leaf = order[:, j]
                need = np.maximum(shared_kth, best.kth().astype(np.float64))
                go = np.flatnonzero(alive[np.arange(len(q)), leaf] & (bound[np.arange(len(q)), leaf] >= need))
                if not len(go):
                    break
                for one in np.unique(leaf[go]):
                    visit(one, go[leaf[go] == one])
        got, col = np.nonzero((best.id != np.iinfo(np.int64).max) & (best.score >= shared_kth[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[got]), pa.array(best.id[got, col]), pa.array(best.score[got, col])], ["query_id", "vec_id", "score"])

    return run


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, x) with x = floor(scale * component), for rows with an id and finite components only."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(finite)
    return rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("x"))


def exact_top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id ``every`` divides.

    Ties go to the smaller id. A row is left out, as query and candidate, if its id, its vector or a
    component is null or not finite. Vectors of different lengths are led to the longest by zeros.
    An id that repeats is several candidates but one query (the smallest vector), and no
    row with the query's id is its candidate. With fewer than k candidates all come back.
    """
    spark = df.sparkSession
    rows = settle(whole_vectors(df, id_col, vec_col, scale))
    count, width, top = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    width = width or 1
    rows = rows.select("id", F.slice(F.concat("x", F.array_repeat(F.lit(0.0), width)), 1, width).alias("x"))
    exact_float = (top or 0) ** 2 * width < 2**52
    shards = rows.repartition(max(1, -(-count // SHARD)))
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("x"))
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    queries = settle(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))
    shards = settle(shards.withColumn("shard", F.spark_partition_id())).repartition(max(1, -(-count // SHARD)), "shard").select("id", "x")
    found = None
    for b in range(blocks):
        part = queries.where(F.col("block") == b).orderBy("id").collect()
        if not part:
            continue
        q_ids, q = np.array([r.id for r in part], dtype=np.int64), np.array([r.x for r in part])
        least = spark.sparkContext.broadcast((q_ids, q, np.full(len(q), -np.inf), exact_float))
        near = shards.mapInArrow(_search(least, k, True), SCHEMA)
        place = Window.partitionBy("query_id").orderBy(F.desc("score"))
        kth = {r.query_id: r.score for r in near.withColumn("r", F.row_number().over(place)).where(F.col("r") == k).collect()}
        bar = np.array([kth.get(i, -np.inf) for i in q_ids.tolist()], dtype=np.float64)
        shared = spark.sparkContext.broadcast((q_ids, q, bar, exact_float))
        hits = shards.mapInArrow(_search(shared, k, False), SCHEMA)
        found = hits if found is None else found.union(hits)
    if found is None:
        found = spark.createDataFrame([], SCHEMA)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
