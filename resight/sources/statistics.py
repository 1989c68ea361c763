"""Stored per-period statistics and posterior draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_js_stats(df: DataFrame, path: str, year: str = "year") -> str:
    df.write.mode("errorifexists").partitionBy(year).parquet(path)
    return path


def read_js_stats(spark: SparkSession, path: str, years=None, year: str = "year") -> DataFrame:
    """Per-year group x date statistics; a year list prunes whole folders before any file opens."""
    df = spark.read.parquet(path)
    return df if years is None else df.where(df[year].isin(list(years)))
