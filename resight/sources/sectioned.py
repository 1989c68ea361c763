"""Sectioned matrix text: ``$name`` headers, delimited rows, 3-D slices headed ``,,a``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

SECTION = r"^\$([A-Za-z0-9_.]+)"
SLICE = r"^,,(\d+)"


def read_sectioned(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Long cells ``(source_file, section, slice, row, col, value)``, where
    ``source_file`` is the path; rows and columns from 1.

    The current section of a line is carried forward from the last header above it.
    The carry runs inside one input split at a time; only one summary row per split
    is carried across a file, so a file of any length is never gathered.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.regexp_replace("value", "\r$", "").alias("text"),
        )
        .withColumn("pos", F.monotonically_increasing_id())
        .where(F.regexp_replace("text", r"[\s,]", "") != "")
        .withColumn("section", F.nullif(F.regexp_extract("text", SECTION, 1), F.lit("")))
        .withColumn("slice", F.nullif(F.regexp_extract("text", SLICE, 1), F.lit("")).cast("int"))
        .withColumn("is_head", F.col("section").isNotNull() | F.col("slice").isNotNull())
    )
    split = ["file_path", "block"]
    inside = W.partitionBy(*split).orderBy("pos")
    numbered = lines.withColumn("in_block", F.row_number().over(inside))
    # slices restart under a new section, so a section head carries slice 0
    head = F.when(F.col("is_head"), F.struct("in_block", "section", F.when(F.col("section").isNotNull(), 0).otherwise(F.col("slice")).alias("slice")))
    name = F.when(F.col("section").isNotNull(), F.col("section"))
    numbered = numbered.withColumn("head", head)

    blocks = numbered.groupBy(*split).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max_by("section", F.when(F.col("section").isNotNull(), F.col("pos"))).alias("last_section"),
        F.max_by(F.col("head.slice"), F.when(F.col("is_head"), F.col("pos"))).alias("last_slice"),
        F.max(F.when(F.col("is_head"), F.col("in_block"))).alias("last_head"),
    )
    before = W.partitionBy("file_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        blocks.withColumn("offset", F.coalesce(F.sum("n_lines").over(before), F.lit(0)))
        .withColumn("head_line", F.col("offset") + F.col("last_head"))
        .select(
            *split,
            "offset",
            F.last("last_section", ignorenulls=True).over(before).alias("prev_section"),
            F.last("last_slice", ignorenulls=True).over(before).alias("prev_slice"),
            F.last("head_line", ignorenulls=True).over(before).alias("prev_head_line"),
        )
    )
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    placed = numbered.select(
        *split,
        "text",
        "is_head",
        "in_block",
        F.last(name, ignorenulls=True).over(upto).alias("own_section"),
        F.last("head", ignorenulls=True).over(upto).alias("own_head"),
    ).join(carried, split)
    rows = placed.where(~F.col("is_head")).select(
        F.col("file_path").alias("source_file"),
        F.coalesce("own_section", "prev_section").alias("section"),
        F.coalesce(F.col("own_head.slice"), F.col("prev_slice"), F.lit(0)).alias("slice"),
        (
            F.col("offset") + F.col("in_block") - F.coalesce(F.col("offset") + F.col("own_head.in_block"), F.col("prev_head_line"), F.lit(0))
        ).cast("int").alias("row"),
        F.posexplode(F.split("text", sep, -1)).alias("cell", "raw"),
    )
    return rows.select(
        "source_file",
        "section",
        "slice",
        "row",
        (F.col("cell") + 1).alias("col"),
        F.expr("try_cast(trim(raw) as double)").alias("value"),
    ).where(F.col("value").isNotNull())


def write_sectioned(cells: DataFrame, path: str, file_key: str, sep: str = "\t") -> str:
    """Long cells back to sectioned text, one folder per ``file_key`` value.

    One text row is one (section, slice, row); its cells are bounded by the matrix width.
    """
    body = cells.groupBy(file_key, "section", "slice", "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: c["value"].cast("double").cast("string")), sep).alias("text")
    )
    heads = cells.select(file_key, "section").distinct().select(file_key, "section", F.lit(-1).alias("slice"), F.lit(0).alias("row"), F.concat(F.lit("$"), F.col("section")).alias("text"))
    slices = (
        cells.where(F.col("slice") > 0)
        .select(file_key, "section", "slice")
        .distinct()
        .select(file_key, "section", "slice", F.lit(0).alias("row"), F.concat(F.lit(",,"), F.col("slice")).alias("text"))
    )
    out = body.unionByName(heads).unionByName(slices)
    (
        out.repartition(file_key)
        .sortWithinPartitions(file_key, "section", "slice", "row")
        .select(file_key, "text")
        .write.partitionBy(file_key)
        .text(path)
    )
    return path
