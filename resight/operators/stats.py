"""Per-period statistics: pooling groups, model inputs, rates and biological counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from resight.functions.mathx import logit
from resight.operators.reshape import column_values
from resight.session import settle

# The per-period statistics, named apart because R/r and T/t differ by case only.
STATS = ("seen", "marked", "first_seen", "recap_later", "recap_now", "at_risk")


def collapse_groups(stats: DataFrame, keys=("year",), date: str = "date", values=("seen", "marked", "first_seen", "recap_later", "recap_now", "missed_now")) -> DataFrame:
    """Sum a table of per-group statistics held as text over its groups, per date.

    Text that is no number counts as missing. One aggregation with a conditional sum per
    statistic; the long form is never shuffled.
    """
    sums = [F.sum(F.expr(f"try_cast({v} as double)")).alias(v) for v in values]
    return stats.groupBy(*keys, F.to_date(date).alias(date)).agg(*sums).na.fill(0.0, list(values))


def js_inputs(stats: DataFrame, keys=("year",), date: str = "date") -> DataFrame:
    """One row per key: number of periods, totals, bounds, mean gap and the prior mean of survival."""
    order = W.partitionBy(*keys).orderBy(date)
    gaps = stats.withColumn("_gap", F.datediff(date, F.lag(date).over(order)))
    total = F.sum("first_seen")
    out = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("s"),
        total.alias("uTot"),
        total.alias("LL"),
        (total * 20).alias("UL"),
        F.avg("_gap").alias("mean_days"),
    )
    return out.withColumn("logit_phi_1_mu_prior", logit(F.exp(F.log(F.lit(0.5)) / F.col("mean_days"))))


def period_inputs(stats: DataFrame, keys=("year",), date: str = "date") -> DataFrame:
    """Per-period model inputs: at risk = missed + recaptured now, days since the last survey."""
    order = W.partitionBy(*keys).orderBy(date)
    return stats.withColumns(
        {
            "t_k": F.row_number().over(order),
            "at_risk": F.col("missed_now") + F.col("recap_now"),
            "days": F.datediff(date, F.lag(date).over(order)),
        }
    )


def good_periods(stats: DataFrame, keys=("year",)) -> DataFrame:
    """Usable periods: someone at risk inside 2..s-1, someone marked inside 1..s-1.

    Each kept period has its rank among the kept ones and the number kept.
    """
    part = W.partitionBy(*keys)
    t, s = F.col("t_k"), F.max("t_k").over(part)
    flagged = stats.withColumn("_s", s)
    kind = F.array_compact(
        F.array(
            F.when((F.col("at_risk") > 0) & (t >= 2) & (t <= F.col("_s") - 1), F.lit("T")),
            F.when((F.col("marked") > 0) & (t <= F.col("_s") - 1), F.lit("R")),
        )
    )
    kept = flagged.select(*keys, "t_k", F.explode(kind).alias("vector"))
    group = W.partitionBy(*keys, "vector")
    return kept.withColumns(
        {"pos": F.row_number().over(group.orderBy("t_k")), "n_good": F.count(F.lit(1)).over(group)}
    )


def pool_strata(cells: DataFrame, keys=("section", "row")) -> DataFrame:
    """Sum the stratum columns of long matrix cells."""
    return cells.groupBy(*keys).agg(F.sum("value").alias("value"))


def check_breakdown(df: DataFrame, states=None) -> DataFrame:
    """Rows failing the movement check, by year and capture reach, a column per recapture reach.

    Without ``states`` those which occur are taken; a list that lacks one of them is refused.
    """
    # counted once: the states are looked up, and spread over columns, in the small table
    failed = settle(df.where(F.col("check") == -1).groupBy("Return_Yr", "TagState", "RecapState").count())
    states = column_values(failed, "RecapState", states)
    return (
        failed
        .groupBy("Return_Yr", "TagState")
        .pivot("RecapState", list(states))
        .agg(F.sum("count"))
        .withColumnsRenamed({str(k): f"recap_{k}" for k in states})
        .orderBy("Return_Yr", "TagState")
    )


def check_total(df: DataFrame) -> DataFrame:
    return df.where(F.col("check") == -1).agg(F.count(F.lit(1)).alias("n"))


def sex_by_year(df: DataFrame, classes=("Adult", "Female", "Jack", "Male", "Need.Another.Category")) -> DataFrame:
    named = {c: c.replace(".", "_") for c in classes}
    return df.groupBy("Return_Yr").agg(
        *[F.nullif(F.count_if(F.col("Sex_Temp") == c), F.lit(0)).alias(a) for c, a in named.items()]
    )


def observed_rates(stats: DataFrame) -> DataFrame:
    """Observed mark rate, recapture rates and share of first detections per period."""
    keys = [c for c in stats.columns if c not in STATS and c != "t_k"]
    total = F.sum("first_seen").over(W.partitionBy(*keys))
    return stats.select(
        *keys,
        "t_k",
        F.try_divide("marked", "seen").alias("obs_v"),
        F.try_divide("recap_now", "at_risk").alias("obs_tau"),
        F.try_divide("recap_later", "marked").alias("obs_lambda"),
        F.try_divide(F.col("first_seen"), total).alias("obs_multP"),
    )


def biodata_counts(df: DataFrame, keys, classes: dict) -> DataFrame:
    """Counts of several yes/no classes and their known totals per key in one pass.

    ``classes`` maps a name to a boolean column; null means not recorded.
    """
    aggs = []
    for name, test in classes.items():
        aggs += [F.count_if(test).alias(f"ex_{name}"), F.count(test).alias(f"tot_{name}")]
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumns({f"p_{n}": F.try_divide(F.col(f"ex_{n}"), F.col(f"tot_{n}")) for n in classes})


def biodata_long(df: DataFrame, keys, kinds: dict) -> DataFrame:
    """One long count table (keys, kind, cls, n) of several classifications of the same rows.

    ``kinds`` maps a name to a column with the row's class; null means not recorded. Rows are counted by all
    classes together first, so the long form has a row for each combination, not for each individual.
    """
    keys, names = list(keys), list(kinds)
    joint = df.groupBy(*keys, *[kinds[k].cast("string").alias(f"_{k}") for k in names]).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("cls")) for k in names]))
    long = joint.select(*keys, "n", each.alias("c")).where("c.cls is not null")
    return long.groupBy(*keys, F.col("c.kind").alias("kind"), F.col("c.cls").alias("cls")).agg(F.sum("n").alias("n"))
