"""Counted detection histories and what is summed from them.

Histories are the first thing computed from individual rows: a partial and a final
count. Every later step works on the counted table, which has one row per distinct
history whatever the number of individuals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from resight.operators.clean import row_index
from resight.operators.joins import match
from resight.operators.reshape import column_values, complete, group_total, period_grid
from resight.session import settle_lookup


def histories(df: DataFrame, keys=("t_k", "r_k", "tag")) -> DataFrame:
    """Number of individuals per distinct history; missing recaptures group together."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def last_period(hist: DataFrame, keys=("t_yr",)) -> DataFrame:
    """Number of periods of every key: the latest capture or recapture."""
    return hist.groupBy(*keys).agg(F.greatest(F.max("t_k"), F.coalesce(F.max("r_k"), F.lit(0))).alias("s"))


def first_detections(hist: DataFrame, bounds: DataFrame, keys=("t_yr",)) -> DataFrame:
    """u per period, zero where nothing was seen."""
    u = hist.groupBy(*keys, "t_k").agg(F.sum("n").alias("u"))
    return complete(u, bounds, keys, fill={"u": 0})


def tag_counts(hist: DataFrame, bounds: DataFrame, keys=("t_yr",)) -> DataFrame:
    """Total, tagged and untagged first detections per period in one pass."""
    counts = hist.groupBy(*keys, "t_k").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("tag"), F.col("n")).otherwise(0)).alias("tagged"),
        F.sum(F.when(F.col("tag"), 0).otherwise(F.col("n"))).alias("untagged"),
    )
    return complete(counts, bounds, keys, fill={"total": 0, "tagged": 0, "untagged": 0})


def location_shares(hist: DataFrame, keys=("t_yr",)) -> DataFrame:
    """Share of individuals by capture location."""
    n = hist.groupBy(*keys, "t_l").agg(F.sum("n").alias("n"))
    return n.withColumn("sp_pr", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def count_tensor(hist: DataFrame, bounds: DataFrame, dims=("t_yr", "t_l")) -> DataFrame:
    """Total and tagged counts over (dims, period), dense in the period."""
    counts = hist.groupBy(*dims, "t_k").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("tag"), F.col("n")).otherwise(0)).alias("tagged")
    )
    cells = match(hist.select(*dims).distinct(), bounds, [c for c in bounds.columns if c in dims])
    return complete(counts, cells, dims, fill={"total": 0, "tagged": 0})


def recapture_matrix(hist: DataFrame, keys=("t_yr",)) -> DataFrame:
    """Tagged individuals by capture and recapture period; a null ``r_k`` is never recaptured."""
    return hist.where(F.col("tag")).groupBy(*keys, "t_k", "r_k").agg(F.sum("n").alias("n"))


def recaps_by_period(hist: DataFrame, bounds: DataFrame, keys=("t_yr",), m_by: str = "r_k") -> DataFrame:
    """m per period. ``m_by="t_k"`` counts recaptured rows by their tagging period instead."""
    m = hist.where(F.col("r_k").isNotNull()).groupBy(*keys, F.col(m_by).alias("t_k")).agg(F.sum("n").alias("m"))
    return complete(m, bounds, keys, fill={"m": 0})


def expand_at_risk(hist: DataFrame, bounds: DataFrame, keys=("t_yr",)) -> DataFrame:
    """Each tagged history once per period from its capture to its recapture or the last period."""
    end = F.coalesce("r_k", "s")
    return (
        match(hist.where(F.col("tag")), bounds, keys)
        .withColumn("period", F.explode(F.when(F.col("t_k") <= end, F.sequence("t_k", end))))
        .where(F.col("period") <= F.col("s"))
        .drop("s")
    )


def at_risk(hist: DataFrame, bounds: DataFrame, keys=("t_yr",)) -> DataFrame:
    """Tagged and available individuals per period.

    Counted from the two ends of each history's span and a running sum over periods,
    so no history is expanded into its periods.
    """
    keys = list(keys)
    end = F.least(F.coalesce("r_k", "s"), F.col("s"))
    steps = (
        match(hist.where(F.col("tag")), bounds, keys)
        .where(F.col("t_k") <= end)
        .select(
            *keys,
            F.explode(F.array(F.struct(F.col("t_k").alias("t_k"), F.col("n").alias("d")), F.struct((end + 1).alias("t_k"), (-F.col("n")).alias("d")))).alias("e"),
        )
        .select(*keys, "e.t_k", "e.d")
        .groupBy(*keys, "t_k")
        .agg(F.sum("d").alias("d"))
    )
    dense = complete(steps, bounds, keys, fill={"d": 0})
    return dense.select(*keys, "t_k", F.sum("d").over(W.partitionBy(*keys).orderBy("t_k")).alias("at_risk"))


def period_pairs(bounds: DataFrame, keys=("t_yr",)) -> DataFrame:
    """Every capture period with every later period of the same season.

    Generated by a sequence per period; there is no join between rows.
    """
    grid = period_grid(bounds.withColumn("_s", F.col("s")), [*keys, "_s"], "s", "t_k")
    later = F.when(F.col("t_k") < F.col("_s"), F.sequence(F.col("t_k") + 1, F.col("_s")))
    return grid.select(*keys, "t_k", F.explode(later).alias("r_k"))


def js_from_histories(hist: DataFrame, bounds: DataFrame, keys=("t_yr",)) -> DataFrame:
    """Per period: seen, marked, first_seen, recap_later, recap_now, at_risk.

    Histories are split into a capture and a recapture record and summed in one
    aggregation; ``at_risk`` is the running difference of the period before.
    """
    keys = list(keys)
    tagged = F.when(F.col("tag"), F.col("n")).otherwise(0)
    again = F.col("tag") & F.col("r_k").isNotNull()
    zero = F.lit(0).cast("long")

    def rec(period, u, R, r, m):
        return F.struct(period.alias("t_k"), u.alias("u"), R.alias("mk"), r.alias("rl"), m.alias("m"))

    ends = F.array(
        rec(F.col("t_k"), F.col("n"), tagged, F.when(again, F.col("n")).otherwise(0), zero),
        rec(F.when(again, F.col("r_k")), zero, zero, zero, F.when(again, F.col("n")).otherwise(0)),
    )
    sums = (
        hist.select(*keys, F.explode(ends).alias("e"))
        .select(*keys, "e.*")
        .where(F.col("t_k").isNotNull())
        .groupBy(*keys, "t_k")
        .agg(*[F.sum(c).alias(c) for c in ("u", "mk", "rl", "m")])
    )
    dense = complete(sums, bounds, keys, fill={"u": 0, "mk": 0, "rl": 0, "m": 0})
    before = W.partitionBy(*keys).orderBy("t_k").rowsBetween(W.unboundedPreceding, -1)
    return dense.select(
        *keys,
        "t_k",
        (F.col("u") + F.col("m")).alias("seen"),
        F.col("mk").alias("marked"),
        F.col("u").alias("first_seen"),
        F.col("rl").alias("recap_later"),
        F.col("m").alias("recap_now"),
        F.coalesce(F.sum(F.col("rl") - F.col("m")).over(before), zero).alias("at_risk"),
    )


def arrival_shares(hist: DataFrame, keys=("t_yr",)) -> DataFrame:
    """Share of history rows (not individuals) by capture period."""
    rows = hist.groupBy(*keys, "t_k").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.withColumn("obs", F.col("n_rows") / F.sum("n_rows").over(W.partitionBy(*keys)))


def mark_rate(hist: DataFrame, keys=("t_yr",)) -> DataFrame:
    """Tagged over all first detections per period."""
    sums = hist.groupBy(*keys, "t_k").agg(F.sum(F.when(F.col("tag"), F.col("n")).otherwise(0)).alias("tagged"), F.sum("n").alias("n"))
    return sums.withColumn("obs_v", F.col("tagged") / F.col("n"))


def transition_counts(hist: DataFrame, keys=(), locations=None) -> DataFrame:
    """Tagged individuals by capture location, one column per recapture location and one for never.

    Without ``locations`` those which occur are taken; a list that lacks one of them is refused.
    """
    never = 0
    locations = column_values(hist.where(F.col("tag")), "r_l", locations)
    return (
        hist.where(F.col("tag"))
        .withColumn("r_l", F.coalesce("r_l", F.lit(never)))
        .groupBy(*keys, "t_l")
        .pivot("r_l", [*locations, never])
        .agg(F.sum("n"))
        .na.fill(0)
        .withColumnsRenamed({**{str(k): f"to_{k}" for k in locations}, str(never): "to_none"})
    )


def transition_table(hist: DataFrame, keys=(), locations=None) -> DataFrame:
    """Row shares of the transition counts to two decimals; the row total sums counts only."""
    locations = column_values(hist.where(F.col("tag")), "r_l", locations)
    counts = transition_counts(hist, keys, locations)
    cols = [f"to_{k}" for k in locations] + ["to_none"]
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return counts.withColumns({f"share_{c}": F.bround(F.col(c) / total, 2) for c in cols})


def obs_in_total(hist: DataFrame, keys=("t_yr", "t_k", "t_l", "tag")) -> DataFrame:
    return group_total(hist, keys)


def reach_index(df: DataFrame, tag: str = "TagReach", recap: str = "RecapReach") -> DataFrame:
    """Number the distinct capture reaches in order and attach the numbers to both ends.

    A recapture reach which never occurs as a capture reach stays null.
    """
    names = df.select(F.col(tag).alias("_name")).where(F.col(tag).isNotNull()).distinct()
    numbered = settle_lookup(row_index(names, ["_name"], "_no"))
    for col, out in ((tag, "t_l"), (recap, "r_l")):
        side = numbered.select(F.col("_name").alias(f"_{out}"), F.col("_no").alias(out))
        df = df.join(side, df[col] == side[f"_{out}"], "left").drop(f"_{out}")
    return df
