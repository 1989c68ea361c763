"""Shares, totals, group numbers, long and wide forms, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from resight.functions.mathx import bound
from resight.operators.clean import row_index
from resight.operators.joins import match
from resight.session import settle_lookup


def share_within(df: DataFrame, keys, value: str = "n", name: str = "share") -> DataFrame:
    """Value over its group total. The input is an aggregate, not raw rows."""
    return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(W.partitionBy(*keys))))


def group_total(df: DataFrame, keys, value: str = "n", name: str = "t_k_total") -> DataFrame:
    """Group total repeated on the rows of a counted table."""
    return df.withColumn(name, F.sum(value).over(W.partitionBy(*keys)))


def group_id(df: DataFrame, keys, name: str = "grp") -> DataFrame:
    """Number groups from 0 in key order.

    The distinct keys are numbered on their own, by a distributed sort, and joined back; no
    window spans the rows.
    """
    keys = list(keys)
    numbered = row_index(df.select(*keys).distinct(), keys, name)
    return match(df, settle_lookup(numbered.withColumn(name, F.col(name) - 1)), keys, "left")


def _share_of_path(df: DataFrame, score, name: str) -> DataFrame:
    """A packed table (a set's periods as ``path``) with each period's share of its set's total score."""
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    shares = bound(score, lambda e: bound(total(e), lambda all_: F.zip_with("path", e, lambda x, one: x.withField(name, F.try_divide(one, all_)))))
    return df.withColumn("path", shares)


def entry_share(df: DataFrame, keys, value: str = "delta", name: str = "pent") -> DataFrame:
    """Of a packed table the periods' structs get the share."""
    if "path" in df.columns:
        return _share_of_path(df, F.transform("path", lambda x: x[value]), name)
    return share_within(df, keys, value, name)


def softmax_share(df: DataFrame, keys, value: str = "b", name: str = "share") -> DataFrame:
    """exp(value) normalised within the group, shifted by the group maximum for safety.

    Of a packed table the periods' structs get the share.
    """
    if "path" in df.columns:
        top = F.array_max(F.transform("path", lambda x: x[value]))
        return _share_of_path(df, bound(top, lambda most: F.transform("path", lambda x: F.exp(x[value] - most))), name)
    part = W.partitionBy(*keys)
    e = df.withColumn("_e", F.exp(F.col(value) - F.max(value).over(part)))
    return e.withColumn(name, F.col("_e") / F.sum("_e").over(part)).drop("_e")


def append(*parts: DataFrame) -> DataFrame:
    """Row-bind by name; a column missing in one part is null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def to_long(df: DataFrame, keys, values, name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(values), name, value)


def to_wide(df: DataFrame, keys, name: str, values, value: str, fill=None) -> DataFrame:
    """Pivot over a declared list of values."""
    out = df.groupBy(*keys).pivot(name, list(values)).agg(F.sum(value))
    return out if fill is None else out.na.fill(fill, [str(v) for v in values])


def melt_array(df: DataFrame, keys, array: str, depth: int) -> DataFrame:
    """A nested array column as long rows ``(keys, dim1, .., value)``, dimensions from 1."""
    cur, dims = df.select(*keys, F.col(array).alias("value")), []
    for d in range(1, depth + 1):
        cur = cur.select(*keys, *dims, F.posexplode("value").alias(f"dim{d}", "value")).withColumn(f"dim{d}", F.col(f"dim{d}") + 1)
        dims.append(f"dim{d}")
    return cur


def period_grid(bounds: DataFrame, keys, last: str = "s", name: str = "t_k") -> DataFrame:
    """One row per period 1..last for every key."""
    return bounds.select(*keys, F.explode(F.when(F.col(last) >= 1, F.sequence(F.lit(1), F.col(last)))).alias(name))


def complete(df: DataFrame, bounds: DataFrame, keys, name: str = "t_k", fill=None, last: str = "s") -> DataFrame:
    """All periods 1..last of every key, missing ones filled."""
    out = match(period_grid(bounds, keys, last, name), df, [*keys, name], "left")
    return out.na.fill(fill or {})


def nonzero_cells(df: DataFrame, value: str = "value", row: str | None = None, col: str | None = None) -> DataFrame:
    """Zero becomes null; with ``row`` and ``col`` only the upper triangle stays."""
    out = df.withColumn(value, F.nullif(F.col(value), F.lit(0)))
    return out if row is None else out.where(F.col(row) <= F.col(col))


def column_setdiff(left: DataFrame, right: DataFrame) -> list[str]:
    """Column names of ``left`` which ``right`` lacks, in order."""
    return [c for c in left.columns if c not in right.columns]


def head(df: DataFrame, order, n: int = 6) -> DataFrame:
    """First n rows in a stated order (a top-n, not a full sort)."""
    return df.orderBy(*order).limit(n)


def mode_of(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """The x at which y is largest; the smallest x among ties."""
    return df.groupBy(*keys).agg(F.max_by(x, F.struct(y, (-F.col(x)).alias("_t"))).alias("mode"))


def column_values(df: DataFrame, name: str, given=None, most: int = 1000) -> list:
    """The values to spread over columns: those which occur, or ``given`` if it lacks none of them.

    Columns have to be few, so more than ``most`` values are an error.
    """
    found = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{name} has over {most} values")
    if given is not None and set(found) - set(given):
        raise ValueError(f"{name} has values that are not listed: {sorted(set(found) - set(given))}")
    return list(found if given is None else given)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def count_by(df: DataFrame, cols) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
