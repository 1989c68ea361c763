"""Token ids of documents as ORC: integer run-length encoding, stripes, row indexes, Bloom filters.

Texts are range-partitioned by document id (rows of one id by a hash of the text too, so a hot id spreads),
sorted, encoded and written; each partition is one file, in ascending order, so the file and
stripe statistics of doc_id are narrow and a reader can skip by them, by the row index and by the Bloom
filter on doc_id. Stripes are read in parallel. No token passes through a shuffle.

Where the tokenizer drops white space and joins no letters across it, which is tried out, a text's ids are those of
its white-space separated parts; each part is encoded by the library once for each worker while
it stays in a bounded memory. Other tokenizers get whole texts. Parts are known by a 64-bit hash; of 10^7 distinct ones
any two agree with a chance of 3 in 10^6.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from resight.llm.words import NOT_SPACE, U, chunks, narrow, split
from resight.session import settle

#: Parts remembered by a worker, about 40 bytes each.
CACHE = 1_000_000
#: So many parts are encoded as one text, with a control character between them that is one token.
RUN = 1_000
MARK = "\x1e"
#: Texts are encoded by chunks of this size: the larger, the more often a part is met again in its chunk.
CHUNK = 1 << 22
STRIPE = 16 << 20
STRIDE = 10_000
SCHEMA = "doc_id long, n_tokens int, ids array<int>"
#: A file is to hold about so many characters of text.
FILE_CHARS = 64 << 20


def _parted(tokenizer) -> bool:
    """Whether the ids of a text are those of its white-space separated parts, on words and spaces of every kind."""
    ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    words = ["a", "Bc.", "12", "\u00c9t\u00e9", "'s", "x-y", "\u4e2d\u6587", "don't", "\u0301z", MARK, "A"]
    return all(ids(gap.join(words)) == [i for w in words for i in ids(w)] for gap in (" ", "\n", "  ", "\t", " \r\n")) and len(ids(MARK)) == 1 and not ids(" ")


class Encoder:
    """Ids of rows of text, part by part. Parts met lately are remembered in sorted arrays; when these are full,
    the parts met since the last time stay and the rest goes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parted = _parted(self.tokenizer)
        self.mark = self._encode([MARK])[0] if self.parted else None
        self.keys, self.at, self.size, self.met = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.pool = np.zeros(0, np.int32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunk(self, c, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk, each row closed by ``end_id``, and each row's first (and the count of all)."""
        rows = len(c.offsets) - 1
        if self.parted:
            w = split(c, NOT_SPACE, lower=False)
            unique, where, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            pool, at, size = self._parts(unique, w.start[where], w.end[where], c.data)
            n = size[inverse]
            take = np.repeat(at[inverse] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            flat, count = pool[take], np.bincount(w.row, n, minlength=rows).astype(np.int64)
        else:
            raw = c.data.tobytes()
            ids = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist())])
            flat, count = np.concatenate([*ids, np.zeros(0, np.int32)]), np.array([len(x) for x in ids], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(count + 1)])
        out = np.full(first[-1], end_id, dtype=np.int32)
        inside = np.ones(first[-1], dtype=bool)
        inside[first[1:] - 1] = False
        out[inside] = flat
        return out, first

    def _parts(self, keys, start, end, data):
        """(ids of many parts, each wanted part's first of these, and their number); keys are sorted."""
        i = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = i < len(self.keys)
        known[inside] = self.keys[i[inside]] == keys[inside]
        self.met[i[known]] = True
        new = np.flatnonzero(~known)
        flat, count = self._fresh([data[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())])
        at, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        at[known], size[known] = self.at[i[known]], self.size[i[known]]
        at[new], size[new] = len(self.pool) + np.cumsum(count) - count, count
        self.pool = np.concatenate([self.pool, flat])
        put = i[new]
        self.keys, self.at, self.size, self.met = (np.insert(x, put, y) for x, y in ((self.keys, keys[new]), (self.at, at[new]), (self.size, size[new]), (self.met, np.zeros(len(new), bool))))
        pool = self.pool
        if len(self.keys) > CACHE:
            keep = np.flatnonzero(self.met) if 2 * self.met.sum() < CACHE else np.zeros(0, np.int64)
            n = self.size[keep]
            self.pool = pool[np.repeat(self.at[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            self.keys, self.size, self.at, self.met = self.keys[keep], n, np.cumsum(n) - n, np.zeros(len(keep), bool)
        return pool, at, size

    def _fresh(self, parts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, and the number of each; many go to the library as one text with a mark between any two."""
        texts = [p.tobytes().decode("utf-8", "replace") for p in parts]
        runs = [texts[lo : lo + RUN] for lo in range(0, len(texts), RUN)]
        flat, count = [], []
        for run, ids in zip(runs, self._encode([f" {MARK} ".join(r) for r in runs])):
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(run) - 1:
                # a part has the mark itself
                each = self._encode(run)
                flat += each
                count += [len(x) for x in each]
                continue
            flat.append(np.delete(ids, cut))
            count += (np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1).tolist()
        return np.concatenate([*flat, np.zeros(0, np.int32)]), np.array(count, dtype=np.int64)


#: One for each tokenizer file and worker, so the tasks of a worker share what it remembers.
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2) -> None:
    """Writes (doc_id, n_tokens, ids) of every row to ``folder``, in ascending order of doc_id.

    n_tokens counts the closing ``end_id``; a null or empty text has it alone. Null ids come first;
    rows that repeat an id are all written, in the order of their texts' hash. An empty table gives
    no rows. Other columns are ignored. ``tokenizer`` is a path that holds on every machine.
    """
    slim = narrow(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    chars = slim.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    cores = slim.sparkSession.sparkContext.defaultParallelism
    parts = int(max(min(cores * 2, 1 + chars // (1 << 20)), chars // FILE_CHARS + 1))

    def run(batches):
        enc = _encoder(tokenizer)
        for b in batches:
            for c in chunks(b.column("text"), CHUNK):
                ids, first = enc.chunk(c, end_id)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(c.lo, c.hi - c.lo), pa.array(np.diff(first).astype(np.int32)), pa.ListArray.from_arrays(first.astype(np.int32), pa.array(ids))], ["doc_id", "n_tokens", "ids"]
                )

    ordered = slim.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h")
    (
        ordered.select("id", "text").mapInArrow(run, SCHEMA).write
        .option("compression", "zstd").option("orc.stripe.size", STRIPE).option("orc.row.index.stride", STRIDE)
        .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .orc(folder)
    )


def read_tokens(spark: SparkSession, folder: str, ids: list[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """The stored rows; a list or a range of document ids is pushed to stripe statistics, row index and Bloom filter."""
    df = spark.read.schema(SCHEMA).orc(folder)
    if ids is not None:
        df = df.where(F.col("doc_id").isin(list(ids)))
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") <= high)
    return df


def _digest(batches):
    for b in batches:
        ids = b.column("ids")
        first, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[x:y]) for x, y in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in KEYS), b.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(crc, pa.int64())], [*KEYS, "doc_id", "n_tokens", "ids_crc32"]
        )


KEYS = ("file", "block", "at")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored row, read back from the files.

    start counts the ids of all rows before it: files follow each other by their number, then
    by place. The running sum goes over one split of one file at a time, and only the splits' totals, a row
    for each, are summed in one task.
    """
    number = F.regexp_extract(F.col("_metadata.file_name"), "^part-([0-9]+)", 1).cast("long")
    rows = spark.read.schema(SCHEMA).orc(folder)
    rows = rows.select("doc_id", "ids", number.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = settle(rows.mapInArrow(_digest, "file long, block long, at long, doc_id long, n_tokens long, ids_crc32 long"))
    totals = rows.groupBy("file", "block").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(totals, ["file", "block"])
    return out.select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
