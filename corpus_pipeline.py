"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, token ids.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, with the columns
of documents; all but the last return those columns. Rows come and go whole: a null or empty
text passes every stage, as no stage finds anything in it; a row with a null id passes too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from resight.llm.decontaminate import contaminated
from resight.llm.line_dedup import dedup_lines
from resight.llm.near_dedup import near_duplicates
from resight.llm.sentencepiece import round_trip
from resight.llm.toxicity import score, train
from resight.session import new_folder, settle_lookup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MODEL = "piece_bpe_32k.model"
#: Rows in one batch to or from a Python worker; the executor and its workers each hold whole batches of texts.
BATCH_ROWS = "1000"


def _as_documents(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it now is."""
    fresh = df.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return fresh.select(*[c for c in COLUMNS if c in like.columns])


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids; rows with a null id stay."""
    gone = settle_lookup(ids.select(F.col("id").alias("gone")).where("gone is not null").distinct())
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these rows' labels outside the held-out fold, calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, train(docs, labels), keep=tuple(c for c in COLUMNS if c in docs.columns))
    return scored.where("predicted = 0").select(*[c for c in COLUMNS if c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near-duplicate lines go; a document of which no word is left goes with them."""
    out = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]")
    return _as_documents(out.where(~F.coalesce(emptied, F.lit(False))), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity .8) the smallest id stays, in one row for each of its texts."""
    found = near_duplicates(docs, shingle=5, num=80, den=100)
    kept = _without(docs, found.where("not kept"))
    twice = settle_lookup(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.limit(1).count():
        # rows that repeat an id and its text are copies too; a text without a word is no one's copy
        again = kept.join(twice, "doc_id", "left_semi")
        worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(again.where(worded).dropDuplicates(["doc_id", "text"])).unionByName(again.where(~worded))
    return _as_documents(kept, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word passage of a benchmark item go."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return _as_documents(_without(docs, found.where("contaminated")), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip): the ids of each text and whether they decode to it."""
    import public_tokenizers

    out = round_trip(docs, public_tokenizers.path(MODEL))
    return out.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", token_ids),
]

#: A trained classifier, a randomised join and subword ids are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BATCH_ROWS)
    try:
        for name, stage in STAGES:
            path = new_folder(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return docs
