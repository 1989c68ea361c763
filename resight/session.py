"""Session defaults for local runs, and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

# Session setting that names the folder of the job at hand.
JOB_FOLDER = "resight.job.folder"
# A lookup is only broadcast once its rows, and the bytes it was written in, are known to be at most this.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 24 << 20


# What has been settled within ``reuse``: hash of the analysed plan -> (table, path).
_REGISTER: ContextVar[dict | None] = ContextVar("settled", default=None)


def local_session(cores: int | str = 8, name: str = "resight") -> SparkSession:
    """Session for tests and benchmarks; on a cluster the submitter's session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RESIGHT_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is accepted only where the master is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        named = tempfile.mkdtemp(prefix="resight-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table inside the job's folder, or else the shared one."""
    return f"{spark.conf.get(JOB_FOLDER, None) or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def job(spark: SparkSession, name: str = "job"):
    """Settled tables made inside share one folder, which is deleted at the end.

    Plans built inside read from it, so write or count their results before leaving.
    """
    outer = spark.conf.get(JOB_FOLDER, None)
    folder = new_folder(spark, name)
    spark.conf.set(JOB_FOLDER, folder)
    try:
        yield folder
    finally:
        if outer is None:
            spark.conf.unset(JOB_FOLDER)
        else:
            spark.conf.set(JOB_FOLDER, outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write a derived table once to the shared folder and read it back.

    Later plans start from the written copy, so a lost executor costs a re-read
    and not a recomputation, and the planner sees the true size.
    """
    return _settled(df)[0]


@contextmanager
def reuse():
    """Inside, a table that was settled before is not computed again: the one with the same analysed plan is read.

    For the length of one query or job only, in which the tables below don't change.
    """
    token = _REGISTER.set({} if _REGISTER.get() is None else _REGISTER.get())
    try:
        yield
    finally:
        _REGISTER.reset(token)


def _settled(df: DataFrame) -> tuple[DataFrame, str]:
    spark, known = df.sparkSession, _REGISTER.get()
    if known is not None:
        # the hash leaves names out, so they are part of what has to agree
        for earlier, path in known.setdefault((df.semanticHash(), tuple(df.columns)), []):
            if earlier.sameSemantics(df):
                return spark.read.schema(df.schema).parquet(path), path
    path = new_folder(spark, "settled")
    df.write.parquet(path)
    if known is not None:
        known[df.semanticHash(), tuple(df.columns)].append((df, path))
    return spark.read.schema(df.schema).parquet(path), path


def written_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a written table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def let_go(spark: SparkSession) -> None:
    """Removes what finished steps have shuffled: Spark keeps these files until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def settle_lookup(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Settle a derived lookup and broadcast it only if it is small, in rows and in bytes.

    Otherwise the plain table is returned, so the join falls back to a
    shuffled one, which adaptive execution splits when a key is hot.
    """
    kept, path = _settled(df)
    small = written_bytes(df.sparkSession, path) <= max_bytes and kept.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(kept) if small else kept
