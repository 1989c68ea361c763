"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resight.session import settle


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for each id that a link (a, b) names; component is its smallest reachable id.

    Alternates two steps until nothing changes: every larger neighbour is hung on the smallest
    of the neighbourhood, then every smaller one. Each is one keyed minimum (combined before the
    shuffle) and one join, so a hub with very many links is split by adaptive execution, and
    nothing but a row count reaches the driver. Self links and nulls are ignored.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    nodes = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = nodes.union(nodes.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node whose larger neighbours left for m keeps its own link to m
        own = least.where("m < u").select("u", F.col("m").alias("v"))
        large = hung.union(own).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        nodes = settle(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = nodes.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tree = nodes.groupBy("u").agg(F.min("v").alias("v"))
    return tree.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tree.select("v", "v").distinct())
