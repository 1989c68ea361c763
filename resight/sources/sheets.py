"""Survey sheets: folders of CSV files whose columns drift from year to year."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from resight.operators.schema import FINAL_SCHEMA
from resight.session import settle

CORRUPT = "_corrupt_record"
# Cells which mean nothing was recorded.
MISSING = ("", "NA")
# Bytes that a header line may have, and files whose headers are read at a time.
HEAD = 1 << 20
OPENED = 16


def _glob(path: str) -> str:
    return path if path.endswith(".csv") else f"{path.rstrip('/')}/*.csv"


def _head(spark: SparkSession, conf, path: str) -> str | None:
    """The first line of a file, through the file system that Spark itself reads it by; None if it can't be read or has none."""
    hadoop = spark._jvm.org.apache.hadoop
    line, stream = hadoop.io.Text(), None
    try:
        at = hadoop.fs.Path(path)
        stream = at.getFileSystem(conf).open(at)
        read = hadoop.util.LineReader(stream).readLine(line, HEAD, HEAD)
    except Py4JJavaError:
        return None
    finally:
        if stream is not None:
            stream.close()
    return line.toString() if read else None


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_path, header): the first line of every readable file, from its first bytes.

    Spark lists the files; the driver, which holds this list for any reader, then opens some of them at
    a time for their first line, so any store that Spark can read will do and no file is scanned. A file that can't be opened, or is empty, is left out.
    """
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(_glob(path)).select("path").collect())
    with ThreadPoolExecutor(OPENED) as pool:
        heads = list(pool.map(lambda f: _head(spark, conf, f), files))
    rows = [(f, f.rsplit("/", 1)[-1], h) for f, h in zip(files, heads) if h is not None]
    return spark.createDataFrame(rows, "file_path string, file string, header string").select("file_path", "file", "header")


def _names(header) -> F.Column:
    """Column names of a header line; commas inside quotes do not separate."""
    return F.transform(F.split(header, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$|\r$|\ufeff', "")))


def column_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its comma-joined column list."""
    return header_lines(spark, path).select("file", F.array_join(_names(F.col("header")), ", ").alias("columns"))


def column_diff(spark: SparkSession, path: str) -> DataFrame:
    """Columns of each file which the first file (by path) lacks."""
    heads = header_lines(spark, path).select("file", "file_path", _names(F.col("header")).alias("names"))
    first = heads.agg(F.min_by("names", "file_path").alias("names")).scalar()
    return heads.select("file", F.array_join(F.array_except("names", first), ", ").alias("extra_columns"))


def _layouts(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """Distinct header -> files having it. The file list is no more than what the
    reader's own file index holds on the driver."""
    rows = (
        header_lines(spark, path)
        .groupBy(_names(F.col("header")).alias("names"))
        .agg(F.sort_array(F.collect_list("file_path")).alias("files"))
        .orderBy("names")
        .collect()
    )
    return [(list(r["names"]), list(r["files"])) for r in rows]


def _known(cell, missing) -> F.Column:
    return F.when(~cell.isin(*missing), cell)


def _read(spark: SparkSession, path: str, columns, layouts, source: bool, tolerant: bool, multiline: bool, missing) -> DataFrame:
    layouts = layouts or _layouts(spark, path)
    if not layouts:
        raise FileNotFoundError(f"no readable CSV file under {path}")
    if columns is None:
        columns = list(dict.fromkeys(name for names, _ in layouts for name in names))
    parts = []
    for names, files in layouts:
        fields = [T.StructField(n, T.StringType()) for n in names]
        reader = spark.read.option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True)
        reader = reader.option("multiLine", multiline).option("escape", '"')
        if tolerant:
            fields.append(T.StructField(CORRUPT, T.StringType()))
            reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        part = reader.schema(T.StructType(fields)).csv(files)
        keep = [_known(F.trim(F.col(f"`{c}`")), missing).alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns]
        if source:
            keep.append(F.col("_metadata.file_name").alias("source_file"))
        if tolerant:
            keep.append(F.col(CORRUPT))
        parts.append(part.select(*keep))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_csv_dir(spark: SparkSession, path: str, columns=None, layouts=None, multiline: bool = False, missing=MISSING) -> DataFrame:
    """All CSV files of a folder, every column as text; missing columns are null, extras dropped.

    Cells in ``missing`` are null.

    There is one scan per distinct header, not per file. ``layouts`` (a list of
    ``(column names, files)``) skips the header pass when the caller knows it.
    ``multiline`` accepts line breaks inside quotes, at the price of unsplit files.
    """
    return _read(spark, path, columns, layouts, source=False, tolerant=False, multiline=multiline, missing=missing)


def read_csv_tolerant(spark: SparkSession, path: str, columns=None, layouts=None, multiline: bool = False, missing=MISSING) -> DataFrame:
    """Same, with ``source_file``; unreadable files are skipped and bad lines are kept in
    ``_corrupt_record``."""
    return _read(spark, path, columns, layouts, source=True, tolerant=True, multiline=multiline, missing=missing)


def read_lookup(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A lookup CSV with declared column types; empty cells and NA are null."""
    return spark.read.option("header", True).option("nullValue", "NA").schema(schema).csv(path)


def write_final(df: DataFrame, path: str, stamp: str, year: str = "Return_Yr", prefix: str = "combined") -> str:
    """CSV folder named with the first and last year and a date stamp; returns its path.

    The table is settled first, since its years have to be known before its name is. Null is
    written as NA.
    """
    df = settle(df)
    span = df.agg(F.min(year).alias("lo"), F.max(year).alias("hi")).first()
    target = f"{path.rstrip('/')}/{prefix}-{span['lo']}_{span['hi']}-{stamp}"
    df.write.mode("errorifexists").option("header", True).option("nullValue", "NA").csv(target)
    return target


def write_final_parquet(df: DataFrame, path: str, year: str = "Return_Yr") -> str:
    """The same table partitioned by year, for readers which prune on it."""
    df.write.mode("errorifexists").partitionBy(year).parquet(path)
    return path


def write_summary(df: DataFrame, path: str, location: str, species: str, year, model: str) -> str:
    """Model summary as CSV; returns the folder, named by location, species, year and model."""
    target = f"{path.rstrip('/')}/summary-results_{location}_{species}_{year}_{model}"
    df.write.mode("errorifexists").option("header", True).csv(target)
    return target


def read_final(spark: SparkSession, path: str) -> DataFrame:
    """The combined table with its declared types; empty cells and NA are null."""
    return spark.read.option("header", True).option("nullValue", "NA").schema(FINAL_SCHEMA).csv(path)


def split_param(df: DataFrame, name: str = "param") -> DataFrame:
    """``lambda[3]`` -> name ``lambda``, idx 3; a scalar has a null idx."""
    idx = F.regexp_extract(name, r"\[(\d+)\]$", 1)
    return df.withColumn("name", F.regexp_replace(name, r"\[\d+\]$", "")).withColumn("idx", F.nullif(idx, F.lit("")).cast("int"))


