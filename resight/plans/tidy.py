"""Raw sheets to the tidy table: one lazy plan with a few settled lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resight.operators import clean, periods, sex
from resight.operators.schema import RAW_COLUMNS, STRATA_BY_SEX, STRATA_SCHEMA
from resight.session import settle
from resight.sources import sheets

# Columns which identify a row for its draw; rows alike in them are numbered in the order of the others.
DRAW_KEYS = ("Return_Yr", "Date_Maiden", "Tag1", "Tag2", "FL", "ScaleAge", "Mark", "Run")
TIE_ORDER = ("Species", "Sex", "RecapTag1", "RecapTag2", "SampleRate", "Comments", "Date_Recap", "TagState", "RecapState")


def formatted(raw: DataFrame, location: str | None, species) -> DataFrame:
    return clean.tag_flags(clean.standardize(clean.filter_species(raw, species), location))


def with_periods(fmt: DataFrame, keys=()):
    """(rows with periods and keys, period table)."""
    master, by_date = periods.create_periods(fmt, keys=keys)
    rows = periods.attach_periods(fmt, by_date, keys=keys)
    return clean.days_between(clean.year_period(rows)), master


def classified(rows: DataFrame, keys=()) -> DataFrame:
    return sex.classify_sex(sex.attach_max_rate(rows, sex.max_rate_by_period(rows, keys=keys), keys))


def imputed(rows: DataFrame, master: DataFrame, seed: int, bio: str, groups: str, draw_keys=None, keys=()) -> DataFrame:
    props, _ = sex.sex_ratios(rows, master, bio, groups, keys)
    if draw_keys is None:
        rows, draw_keys = clean.number_ties(rows, (*keys, *DRAW_KEYS), TIE_ORDER, telling=("Tag1", "Tag2")), (*DRAW_KEYS, "Row_No")
    return sex.impute_category(sex.attach_sex_props(rows, props, keys), seed, draw_keys).drop("Row_No")


def strata_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRATA_BY_SEX, STRATA_SCHEMA)


def tidy(raw: DataFrame, location: str | None, species, strategy: int = 3, seed: int = 298, bio: str = "tagged", groups: str = "female_male", draw_keys=None) -> DataFrame:
    """The 23-column table from raw sheets.

    ``location=None`` takes many locations at once from a ``Location`` column; periods,
    rates and ratios are then kept by location. Every row has a draw of its own, from its
    fields and its number among rows alike in them; where the sheets have a unique key, name it in ``draw_keys``.

    The standardised rows are settled once. The period list, the sample rates and the sex
    ratios are then narrow scans of that columnar copy instead of a parse of the sheets each.
    """
    keys = ("Location",) if location is None else ()
    rows, master = with_periods(settle(formatted(raw, location, species)), keys)
    done = imputed(classified(rows, keys), master, seed, bio, groups, draw_keys, keys)
    strata = sex.attach_strata(done, strata_lookup(raw.sparkSession), strategy)
    return clean.final_select(clean.final_filter(strata))


def tidy_folder(spark: SparkSession, path: str, location: str | None, species, **options) -> DataFrame:
    """Same, from a folder of CSV sheets."""
    columns = RAW_COLUMNS if location else [*RAW_COLUMNS, "Location"]
    return tidy(sheets.read_csv_dir(spark, path, columns), location, species, **options)
