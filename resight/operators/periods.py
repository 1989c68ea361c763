"""Survey periods: weeks per return year, their numbering, gaps, and the date map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from resight.functions.calendar import week_sunday
from resight.operators.joins import match
from resight.session import settle_lookup


def union_dates(df: DataFrame, capture: str = "Date_Maiden", recapture: str | None = "Date_Recap", year: str = "Return_Yr", keys=()) -> DataFrame:
    """Distinct non-null survey dates per year (and key), from captures and recaptures.

    Both columns are exploded in one pass over the rows; the distinct is partially
    aggregated before it shuffles, so at most one row per date leaves each task.
    """
    cols = [capture] if recapture is None else [capture, recapture]
    dates = df.select(*keys, F.col(year).try_cast("int").alias("Year"), F.explode(F.array(*cols)).alias("Date"))
    return dates.na.drop(subset=["Year", "Date"]).distinct()


def mid_date(lo: str = "Date_Min", hi: str = "Date_Max"):
    """The single date, or one day before the last."""
    return F.when(F.col(hi) == F.col(lo), F.col(lo)).otherwise(F.date_sub(F.col(hi), 1))


def survey_weeks(dates: DataFrame, keys=()) -> DataFrame:
    """Per (keys, Year, week): number of dates, first, last and middle date."""
    return (
        dates.groupBy(*keys, "Year", week_sunday("Date").alias("week"))
        .agg(
            F.count_distinct("Date").alias("n_surveys"),
            F.min("Date").alias("Date_Min"),
            F.max("Date").alias("Date_Max"),
        )
        .withColumn("Date_Mid", mid_date())
    )


def period_numbers(weeks: DataFrame, keys=()) -> DataFrame:
    """Number the weeks of a year by their middle date."""
    order = W.partitionBy(*keys, "Year").orderBy("Date_Mid", "week")
    return weeks.withColumn("Period", F.row_number().over(order))


def manual_periods(lut: DataFrame, year: int, project: str) -> DataFrame:
    """User-defined periods of one project and year."""
    return (
        lut.where((F.col("ui_return_year") == year) & (F.col("ui_project_name") == project))
        .groupBy(F.col("ui_return_year").cast("int").alias("Year"), F.col("Period_Num").cast("int").alias("Period"))
        .agg(
            F.count(F.lit(1)).alias("n_surveys"),
            F.min("Survey_Date").alias("Date_Min"),
            F.max("Survey_Date").alias("Date_Max"),
        )
        .withColumn("week", week_sunday("Date_Min"))
        .withColumn("Date_Mid", mid_date())
    )


def period_gaps(periods: DataFrame, within_year: bool = False, keys=()) -> DataFrame:
    """Days since the previous middle date and the date half-way to the next one.

    The default runs over all years of a key in (Year, Date_Mid) order; a key has about
    fifty rows a year. ``within_year=True`` restarts every year. A last row without a
    successor takes half the median gap.
    """
    part = W.partitionBy(*keys, "Year") if within_year else W.partitionBy(*(keys or [F.lit(1)]))
    order = part.orderBy("Year", "Date_Mid", "Period")
    out = periods.withColumn("Days_Btw_Periods", F.datediff("Date_Mid", F.lag("Date_Mid").over(order)).cast("double"))
    half = F.bround(F.lead("Days_Btw_Periods").over(order) / 2, 0).cast("int")
    out = out.withColumn("_median", F.median("Days_Btw_Periods").over(part))
    return (
        out.withColumn("_half", half)
        .withColumn(
            "MidDate_Btw_Periods",
            F.coalesce(F.date_add("Date_Mid", F.col("_half")), F.date_add("Date_Mid", F.floor(F.col("_median") / 2).cast("int"))),
        )
        .withColumn("Year_Period", F.concat_ws("_", F.col("Year").cast("string"), F.col("Period").cast("string")))
        .select(
            *keys, "Year", "Period", "Year_Period", "week", "n_surveys", "Date_Min", "Date_Mid", "Date_Max",
            "Days_Btw_Periods", "MidDate_Btw_Periods",
        )
    )


def assign_period(dates: DataFrame, periods: DataFrame, keys=()) -> DataFrame:
    """Date -> first period whose range holds it, per year (and key).

    A range join on an equi-key: every range is spread over the months it touches, so
    a date meets only ranges of its own year and month; the first match is the minimum.
    """
    month = lambda d: F.year(d) * 12 + F.month(d)
    spread = periods.select(
        *keys, "Year", "Period", "Date_Min", "Date_Max", F.explode(F.sequence(month("Date_Min"), month("Date_Max"))).alias("_month")
    )
    keyed = dates.withColumn("_month", month("Date"))
    hit = match(keyed, spread, [*keys, "Year", "_month"], "left").where(
        F.col("Period").isNull() | F.col("Date").between(F.col("Date_Min"), F.col("Date_Max"))
    )
    # a date whose month holds only non-matching ranges drops out above and returns here
    found = hit.groupBy(*keys, "Year", "Date").agg(F.min("Period").alias("Period"))
    return match(dates, found, [*keys, "Year", "Date"], "left")


def create_periods(df: DataFrame, capture: str = "Date_Maiden", recapture: str | None = "Date_Recap", year: str = "Return_Yr", within_year: bool = False, keys=()):
    """(period table, date map) of a standardised table.

    ``keys`` (for instance the location) numbers the periods of each key on their own.
    """
    dates = settle_lookup(union_dates(df, capture, recapture, year, keys))
    weeks = period_numbers(survey_weeks(dates, keys), keys)
    return period_gaps(weeks, within_year, keys), assign_period(dates, weeks, keys)


def attach_periods(df: DataFrame, date_map: DataFrame, by_year: bool = True, keys=()) -> DataFrame:
    """Period of capture and of recapture by two left joins on the date map.

    ``by_year=False`` looks dates up without their year, so a date that belongs to two
    return years duplicates rows.
    """
    lookup = settle_lookup(date_map)
    for date, name in (("Date_Maiden", "Period_Cap"), ("Date_Recap", "Period_Recap")):
        side = lookup.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("Year").alias("_y"), F.col("Date").alias("_d"), F.col("Period").alias(name))
        on = df[date] == side["_d"]
        if by_year:
            on = on & (df["Return_Yr"].try_cast("int") == side["_y"])
        for k in keys:
            on = on & df[k].eqNullSafe(side[f"_{k}"])
        df = df.join(side, on, "left").drop("_y", "_d", *[f"_{k}" for k in keys])
    return df


def survey_gaps(df: DataFrame, date: str = "date", keys=("year",)) -> DataFrame:
    """Days since the previous survey, null at the first."""
    order = W.partitionBy(*keys).orderBy(date)
    return df.withColumn("days", F.datediff(date, F.lag(date).over(order)))


def missing_periods(periods: DataFrame, seen: DataFrame, key: str = "Year_Period") -> DataFrame:
    """Periods that never occur in ``seen``."""
    return periods.join(seen.select(key).distinct(), key, "left_anti")


def sort_periods(periods: DataFrame) -> DataFrame:
    return periods.orderBy("Year", "Period")
