"""Row rules from raw sheets to the standardised table. No rule here shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from resight.functions.calendar import parse_date, week_block, week_rollover
from resight.operators.joins import match
from resight.operators.schema import FINAL_COLUMNS
from resight.session import BROADCAST_ROWS, settle, settle_lookup


def filter_species(df: DataFrame, keep, col: str = "SPECIES") -> DataFrame:
    return df.where(F.col(col).isNotNull() & F.col(col).isin(list(keep)))


def number_in(text) -> Column:
    """First run of digits as an integer, null when there is none."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def movement_check(df: DataFrame, tag: str = "TagState", recap: str = "RecapState") -> DataFrame:
    """-1 where both reaches are known and the recapture lies below the capture, else 1."""
    bad = F.col(tag).isNotNull() & F.col(recap).isNotNull() & (F.col(tag) > F.col(recap))
    return df.withColumn("check", F.when(bad, -1).otherwise(1))


def standardize(df: DataFrame, location: str | None, date_order: str = "dmy") -> DataFrame:
    """Typed dates and reaches, the location constant, and the movement check.

    With ``location=None`` the table brings its own ``Location`` column.
    """
    out = (
        df.withColumnRenamed("SPECIES", "Species")
        .withColumn("Location", F.col("Location") if location is None else F.lit(location))
        .withColumn("Date_Maiden", parse_date("TagDate", date_order))
        .withColumn("Date_Recap", parse_date("RecapDate", date_order))
        .withColumn("TagState", number_in("TagReach"))
        .withColumn("RecapState", number_in("RecapReach"))
    )
    out = movement_check(out).drop("TagDate", "TagReach", "RecapDate", "RecapReach")
    lead = ["Location", "Return_Yr", "Species", "Run", "Sex", "FL", "Mark", "ScaleAge"]
    return out.select(*lead, *[c for c in out.columns if c not in lead])


def tag_flags(df: DataFrame) -> DataFrame:
    """Tagged 1/0; Recap 1/0 for tagged rows and null for untagged ones."""
    tagged = F.col("Tag1").isNotNull() | F.col("Tag2").isNotNull()
    again = F.col("RecapTag1").isNotNull() | F.col("RecapTag2").isNotNull()
    return df.withColumn("Tagged", F.when(tagged, 1).otherwise(0)).withColumn(
        "Recap", F.when(tagged & again, 1).when(tagged, 0)
    )


def year_period(df: DataFrame) -> DataFrame:
    """Text keys ``year_period`` for capture and recapture; a missing part reads NA."""

    def key(period: str) -> Column:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("Return_Yr", period)]
        return F.concat_ws("_", *parts)

    return df.withColumns({"Year_Period": key("Period_Cap"), "Year_Period_Recap": key("Period_Recap")})


def days_between(df: DataFrame) -> DataFrame:
    gap = F.datediff("Date_Recap", "Date_Maiden").cast("double")
    return df.withColumn("days_between_capture", F.when(F.col("Recap") == 1, gap))


def final_filter(df: DataFrame) -> DataFrame:
    """Recaptures at least a day later or no recapture; the stratum must be known."""
    return df.where(((F.col("days_between_capture") > 0) | F.col("Date_Recap").isNull()) & F.col("Strata_Name").isNotNull())


def final_select(df: DataFrame) -> DataFrame:
    """The tidy table's columns with their names and types."""
    renamed = df.drop(*[c for c in df.columns if c.startswith("Prop_Sex")]).withColumnsRenamed(
        {"Sex": "Sex_original", "Date_Maiden": "Date_Cap", "Year_Period": "Year_Period_Cap"}
    )
    typed = renamed.withColumns({"Return_Yr": F.col("Return_Yr").try_cast("int"), "FL": F.col("FL").try_cast("double")})
    return typed.select(*FINAL_COLUMNS)


def period_index_week(df: DataFrame, year=None, min_week: int = 10) -> DataFrame:
    """Seven-day block weeks, early weeks dropped, periods counted from each season's first week.

    Rows recaptured before the season's first week are dropped.
    """
    out = df.withColumns(
        {
            "t_wk": week_block("Date_Maiden"),
            "r_wk": week_block("Date_Recap"),
            "t_yr": F.year("Date_Maiden"),
        }
    ).where(F.col("t_wk") > min_week)
    if year is not None:
        out = out.where(F.col("t_yr") == year)
    first = settle_lookup(out.groupBy("t_yr").agg(F.min("t_wk").alias("first_wk")))
    out = out.join(first, "t_yr").withColumns(
        {"t_k": F.col("t_wk") - F.col("first_wk") + 1, "r_k": F.col("r_wk") - F.col("first_wk") + 1}
    )
    return out.where(F.col("r_wk").isNull() | (F.col("r_k") > 0)).drop("first_wk")


def roll_weeks(df: DataFrame, pivot: int = 20, add: int = 52) -> DataFrame:
    """Weeks before ``pivot`` belong to the season that began the year before."""
    return df.withColumns({c: week_rollover(c, pivot, add) for c in ("t_wk", "r_wk")})


def follow_weeks(df: DataFrame, add: int = 52) -> DataFrame:
    """Seasons of a calendar year: a recapture week before its capture week is one of the next year."""
    return df.withColumn("r_wk", F.when(F.col("r_wk") < F.col("t_wk"), F.col("r_wk") + add).otherwise(F.col("r_wk")))


def rebase_periods(df: DataFrame, keys=("t_yr",), sequential: bool = False) -> DataFrame:
    """Shift ``t_k`` and ``r_k`` so that each season starts at 1.

    ``sequential=True`` reproduces the step-by-step assignment in which ``t_k`` is
    already shifted when ``r_k`` is computed, so ``r_k`` keeps its value.
    """
    keys = list(keys)
    first = settle_lookup(df.groupBy(*keys).agg(F.min("t_k").alias("first_k")))
    shift = F.col("first_k") - 1
    out = match(df, first, keys)
    r_k = F.col("r_k") if sequential else F.col("r_k") - shift
    return out.withColumns({"t_k": F.col("t_k") - shift, "r_k": r_k}).drop("first_k")


def upstream_filter(df: DataFrame, tag: str = "t_l", recap: str = "r_l") -> DataFrame:
    return df.where(F.col(recap).isNull() | (F.col(recap) >= F.col(tag)))


def pool_locations(df: DataFrame) -> DataFrame:
    return df.withColumns({"t_l": F.lit(1), "r_l": F.when(F.col("r_l").isNotNull(), 1)})


# Scale-age codes meaning "not aged".
UNAGED = ("9", "88")


def ocean_age(df: DataFrame, col: str = "ScaleAge") -> DataFrame:
    """First digit minus second digit of the age code, -1 where not aged."""
    digit = [F.expr(f"try_cast(substring({col}, {i}, 1) as int)") for i in (1, 2)]
    return df.withColumn("oa", F.when(F.col(col).isNull() | F.col(col).isin(*UNAGED), -1).otherwise(digit[0] - digit[1]))


def recode_sex(df: DataFrame, unknown=("Unknown", "Adult"), col: str = "Sex") -> DataFrame:
    return df.withColumn(col, F.when(F.col(col).isNull() | F.col(col).isin(*unknown), "-1").otherwise(F.col(col)))


def number_ties(df: DataFrame, keys, order, name: str = "Row_No", telling=()) -> DataFrame:
    """Numbers from 1 the rows which are alike in ``keys``, by a digest of ``order``.

    Rows alike in all columns are counted (in part before the shuffle) and given back with
    their numbers, so a large run of equal rows never meets in one task; the window sees one row for each
    distinct combination of the other columns.

    ``telling`` names key columns (tags) that tell most rows apart. Of rows that have one only a hash of the
    keys is shuffled; those whose hash occurs once are number 1 where they lie.
    """
    if telling:
        told = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in telling])
        hashed = df.withColumn("_k", F.when(told, F.xxhash64(*keys)))
        again = settle(hashed.where(told).groupBy("_k").count().where("count > 1").select("_k"))
        # so many that they can't be looked up: all rows are gathered
        if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            again = F.broadcast(again)
            # a null hash meets no other, so rows without a tag are gathered as well
            tied = hashed.where("_k is null").union(hashed.join(again, "_k", "left_semi").select(hashed.columns)).drop("_k")
            alone = hashed.where("_k is not null").join(again, "_k", "left_anti").select(*df.columns, F.lit(1).cast("long").alias(name))
            return number_ties(tied, keys, order, name).union(alone)
    rest = [c for c in df.columns if c not in keys]
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in order]))
    same = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_d", digest)
    before = W.partitionBy(*keys).orderBy("_d", *rest).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0))
    placed = same.withColumn("_start", start)
    return placed.select(*df.columns, F.explode(F.sequence(F.col("_start") + 1, F.col("_start") + F.col("_n"))).alias(name))


def row_index(df: DataFrame, order, name: str = "Index") -> DataFrame:
    """Sequential 1..n in the given order, computed without a single-task sort.

    Rows are range-partitioned and sorted, with the source position as last sort key
    so that a run of equal rows is also spread. The sorted table is written to the
    shared folder with its partition number and its position in it; the row number is
    then the position plus the size of all earlier partitions.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = (
        df.withColumn("_src", F.monotonically_increasing_id())
        .repartitionByRange(*order, F.col("_src"))
        .sortWithinPartitions(*order, F.col("_src"))
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_src")
    )
    kept = settle(placed)
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # one row per shuffle partition, whatever the data holds
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_pos") + 1).drop("_part", "_pos", "_before")
