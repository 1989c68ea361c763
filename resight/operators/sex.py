"""Sex classes, ratios and imputation; strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from resight.functions.draws import pick, uniform
from resight.operators.joins import match
from resight.operators.reshape import append, share_within
from resight.session import settle, settle_lookup

# Sex calls and comments with a meaning of their own.
UNKNOWN_CALLS = ("Unknown", "unknown", "UNK", "Unk")
JACK_COMMENTS = ("JACKS", "Jacks", "jacks", "jack card")
CLASSES = ("Jack", "Female", "Male")
UNRESOLVED = "Need.Another.Category"


def _comparable(col: str, lexical: bool):
    """A text column as a number, or as text when the comparison is to be lexical."""
    return F.col(col).cast("string") if lexical else F.expr(f"try_cast({col} as double)")


def max_rate_by_period(df: DataFrame, compare: str = "numeric", keys=()) -> DataFrame:
    """Largest sample rate of every period, a missing rate counting as 1."""
    rate = F.coalesce(_comparable("SampleRate", compare == "lexical"), F.lit("1") if compare == "lexical" else F.lit(1.0))
    return df.groupBy(*keys, "Year_Period").agg(F.max(rate).cast("double").alias("Max_Rate"))


def attach_max_rate(df: DataFrame, rates: DataFrame, keys=()) -> DataFrame:
    return match(df, settle_lookup(rates), [*keys, "Year_Period"], "left")


def classify_sex(df: DataFrame, cutoff: int = 59, compare: str = "numeric") -> DataFrame:
    """First matching rule decides; needs ``Max_Rate``.

    Missing and unknown calls are adults, field calls of females and jacks stand. A male
    call becomes a jack by sub-sampling, by the crew's comment, or by fork length in
    periods which were sampled in full. Null tests fall through to the next rule.
    """
    lexical = compare == "lexical"
    rate, length = _comparable("SampleRate", lexical), _comparable("FL", lexical)
    one, cut = (F.lit("1"), F.lit(str(cutoff))) if lexical else (F.lit(1.0), F.lit(float(cutoff)))
    male, full = F.col("Sex") == "Male", F.col("Max_Rate") == 1
    rules = [
        (F.col("Sex").isNull() | (F.col("Sex") == "Adult") | F.col("Sex").isin(*UNKNOWN_CALLS), "Adult"),
        (F.col("Sex") == "Female", "Female"),
        (F.col("Sex") == "Jack", "Jack"),
        (male & (rate == one) & (F.col("Max_Rate") > 1), "Jack"),
        (male & F.col("Comments").isin(*JACK_COMMENTS), "Jack"),
        (male & (rate > one), "Male"),
        (male & (length > cut), "Male"),
        (male & full & (length <= cut), "Jack"),
        (male & full & length.isNull(), "Male"),
    ]
    chain = F
    for test, label in rules:
        chain = chain.when(test, label)
    return df.withColumn("Sex_Temp", chain.otherwise(UNRESOLVED))


def sex_sample(df: DataFrame, bio: str = "tagged", groups: str = "female_male") -> DataFrame:
    kept = ("Jack", "Female", "Male") if groups == "jack_female_male" else ("Female", "Male")
    out = df.where(F.col("Sex_Temp").isin(*kept))
    return out.where(F.col("Tagged") == 1) if bio == "tagged" else out


def _wide(counts: DataFrame, keys) -> DataFrame:
    """Share and count per class as columns; a class without rows has share 0, count null."""
    aggs = []
    for c in CLASSES:
        mine = F.when(F.col("Sex_Temp") == c, F.col("Count"))
        aggs.append((F.coalesce(F.sum(mine), F.lit(0)) / F.sum("Count")).alias(f"Prop_Sex_{c}"))
        aggs.append(F.sum(mine).alias(f"Count_{c}"))
    return counts.groupBy(*keys).agg(*aggs)


def sex_ratios(df: DataFrame, periods: DataFrame, bio: str = "tagged", groups: str = "female_male", keys=()):
    """(per period, total): share and count of each class; empty periods take the total's.

    Rows are counted once per (year, period, class); the period table, the total and the
    list of empty periods all come from that small table.
    """
    sample = sex_sample(df, bio, groups)
    counts = settle(
        sample.groupBy(*keys, F.col("Return_Yr").try_cast("int").alias("Year"), F.col("Period_Cap").alias("Period"), "Year_Period", "Sex_Temp").agg(F.count(F.lit(1)).alias("Count"))
    )
    total = _wide(counts, [*keys, F.lit("Total").alias("Year_Period")])
    per_period = _wide(counts, [*keys, "Year", "Period", "Year_Period"])
    empty = match(periods.select(*keys, "Year", "Period", "Year_Period"), counts.select(*keys, "Year_Period").distinct(), [*keys, "Year_Period"], "left_anti")
    if keys:
        filled = match(empty, total.drop("Year_Period"), keys, "left")
    else:
        one = total.select(F.struct(*[c for c in total.columns if c != "Year_Period"]).alias("t")).scalar()
        filled = empty.select("*", one.alias("t")).select(*empty.columns, "t.*")
    return append(per_period, filled), total


def class_shares(df: DataFrame) -> DataFrame:
    """Long form of the same: count and share of each class within its period."""
    counts = df.groupBy("Year_Period", "Sex_Temp").agg(F.count(F.lit(1)).alias("Count"))
    return share_within(counts, ["Year_Period"], "Count", "Prop_Sex")


def attach_sex_props(df: DataFrame, props: DataFrame, keys=()) -> DataFrame:
    """Join the period's shares; a class that was not sampled has share 0."""
    cols = [f"Prop_Sex_{c}" for c in CLASSES]
    have = [c for c in cols if c in props.columns]
    out = match(df, settle_lookup(props.select(*keys, "Year_Period", *have)), [*keys, "Year_Period"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0) for c in cols})


def impute_category(df: DataFrame, seed: int, keys, choices=("Male", "Female", "Jack")) -> DataFrame:
    """Draw a class from the period's shares; a field call wins over the draw."""
    drawn = pick(uniform(seed, *keys), [(c, F.col(f"Prop_Sex_{c}")) for c in choices])
    called = F.col("Sex_Temp").isin(*choices)
    return df.withColumn("Sex_Interpol", drawn).withColumn("Sex_final", F.when(called, F.col("Sex_Temp")).otherwise(F.col("Sex_Interpol")))


def strata_of(lut: DataFrame, strategy: int) -> DataFrame:
    """The rows of the strata lookup for one grouping strategy."""
    return lut.where(F.col("Grouping_Strategy_Num") == strategy).drop("Grouping_Strategy_Num")


def attach_strata(df: DataFrame, lut: DataFrame, strategy: int) -> DataFrame:
    """Left join on the final class. Rows whose class has no stratum keep a null one."""
    return df.join(settle_lookup(strata_of(lut, strategy)), "Sex_final", "left")
