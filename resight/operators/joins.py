"""Joins on grouping keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def match(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on keys in which null equals null, as it does in grouping.

    A group whose key is missing (an unknown stratum, a scalar parameter without an index)
    so keeps its row. Each key appears once in the result.
    """
    keys = list(keys)
    names = {k: f"_right_{k}" for k in keys}
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(names[k])) for k in keys])
    out = left.join(right.withColumnsRenamed(names), on, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how == "full":
        # a missing left row is told from a null key by the right key alone
        cols = [F.coalesce(k, names[k]).alias(k) for k in keys]
    else:
        cols = [F.col(k) for k in keys]
    rest = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return out.select(*cols, *rest)
