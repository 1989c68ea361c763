"""Phrase collocations by set-oriented mining over sorted occurrence relations (SETM).

The relation of length k holds every occurrence of a frequent phrase of k words, sorted by place:
for each text the places, rising by one inside a piece and by two or more between
pieces, and the phrase's number. It is written, merge-joined with itself on piece and
adjacent place, which gives the occurrences of length k + 1; those are counted in
groups, and the occurrences are semi-joined with the groups that reach the least count before the next
length. Phrases of one length are numbered densely in the order of their keys, so the two numbers of a joined
pair, packed into one 64-bit key, name the longer phrase exactly.

A semi-join is a lookup in a sorted array where the frequent groups are few (``LOOKUP`` of eight bytes at
most), otherwise a join of the exploded relation, regrouped by text. Occurrences pass through a shuffle only in that case;
counts are made in each task before the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from resight.llm.words import LOWER, U, chunks, freeing, mix, split
from resight.operators.clean import row_index
from resight.session import settle

LOOKUP = 1 << 21
#: Keys that a task gathers before it counts them.
HELD = 1 << 21
#: Occurrences of a relation that are worked on at a time: texts are taken in runs of about so many.
PORTION = 1 << 18
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD = ~SEPARATOR
WORD[[32, 9]] = False
RELATION = "row long, step array<int>, item array<long>"
PLACED = "row long, at array<int>, key array<long>"


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _tokens(b):
    """For each chunk of a batch (row, lang, text): the chunk, its words, their keys and places; a key is the word's hash in its language."""
    langs = b.column("lang").dictionary_encode()
    salts = np.array([_salt(x) for x in langs.dictionary.to_pylist()] or [0], dtype=U)
    code = langs.indices.to_numpy()
    for c in chunks(b.column("text")):
        w = split(c, WORD)
        piece = np.cumsum(SEPARATOR[c.data])[w.start] if len(w.start) else w.start
        gap = np.ones(len(piece), np.int64)
        gap[1:] += piece[1:] != piece[:-1]
        place = np.cumsum(gap)
        yield c, w, mix(w.hash + salts[code[c.lo : c.hi]][w.row]).view(np.int64), place, code[c.lo : c.hi][w.row]


def _count_words(batches):
    """Rows (lang, word, key, n), n in this chunk."""
    for b in batches:
        names = b.column("lang").dictionary_encode().dictionary
        for c, w, key, _, code in _tokens(b):
            u, where, n = np.unique(key, return_index=True, return_counts=True)
            start, size = w.start[where], (w.end - w.start)[where]
            offsets = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
            text = pa.LargeStringArray.from_buffers(len(u), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOWER[c.data[take]].tobytes()))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(code[where])), text.cast(pa.string()), pa.array(u), pa.array(n)], ["lang", "word", "key", "n"])


def _first_keys(batches):
    """Texts -> the relation of all words, unnumbered."""
    for b in batches:
        for c, w, key, place, _ in _tokens(b):
            offsets = pa.array(w.first.astype(np.int32))
            at = place - np.append(place, 0)[w.first[:-1]][w.row] if len(place) else place
            yield pa.RecordBatch.from_arrays(
                [b.column("row").slice(c.lo, c.hi - c.lo), pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(key))], ["row", "at", "key"]
            )


def _portions(batches, column):
    """Runs of whole rows with about ``PORTION`` items of a list column, so memory does not follow the Arrow batch."""
    for b in batches:
        first, lo = b.column(column).offsets.to_numpy(), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(first, int(first[lo]) + PORTION, side="right")) - 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def _joined(batches):
    """The relation of one length -> that of the next, unnumbered: occurrences at adjacent places of a piece."""
    for b in _portions(batches, "step"):
        step, item = b.column("step"), b.column("item")
        first = step.offsets.to_numpy().astype(np.int64)
        s, v = step.values.to_numpy()[first[0] : first[-1]].astype(np.int64), item.values.to_numpy()
        v = v[item.offsets[0].as_py() :][: len(s)]
        first = first - first[0]
        place = np.cumsum(s)
        row = np.repeat(np.arange(b.num_rows), np.diff(first))
        place -= np.concatenate([[0], place])[first[:-1]][row] if len(s) else 0
        i = np.flatnonzero((s[1:] == 1) & (row[1:] == row[:-1]))
        offsets = pa.array(np.searchsorted(row[i], np.arange(b.num_rows + 1)).astype(np.int32))
        key = (v[i] << 32) | v[i + 1]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.ListArray.from_arrays(offsets, pa.array(place[i].astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(key))], ["row", "at", "key"])


def _tally(keys):
    """Occurrences -> rows (key, n), counted for some millions at a time."""

    def run(batches):
        held, n = [], 0

        def counted():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(c)], ["key", "n"])

        for b in keys(batches):
            held.append(b.column("key").flatten().to_numpy())
            n += len(held[-1])
            if n > HELD:
                yield counted()
                held, n = [], 0
        if held:
            yield counted()

    return freeing(run)


def _number(keys, shared):
    """Occurrences -> the relation of those whose key is frequent; a key's number is its place in the sorted array."""

    def run(batches):
        wanted = shared.value
        for b in keys(batches):
            at, key = b.column("at"), b.column("key")
            first = key.offsets.to_numpy()
            k = key.values.to_numpy()
            i = np.minimum(np.searchsorted(wanted, k), max(len(wanted) - 1, 0))
            ok = wanted[i] == k if len(wanted) else np.zeros(len(k), bool)
            place = at.values.to_numpy()[ok].astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(ok)])[first]
            yield pa.RecordBatch.from_arrays([b.column("row"), *_steps(offsets, place, i[ok])], ["row", "step", "item"])

    return freeing(run)


def _steps(offsets, place, item):
    """Places of each text as steps from the one before: mostly ones, so they take little room."""
    step = np.diff(place, prepend=0)
    heads = offsets[:-1][np.diff(offsets) > 0]
    step[heads] = place[heads]
    at = pa.array(offsets.astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.array(step.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(item.astype(np.int64)))


def _repack(batches):
    for b in _portions(batches, "at"):
        at = b.column("at")
        first = at.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays([b.column("row"), *_steps(first - first[0], at.flatten().to_numpy().astype(np.int64), b.column("item").flatten().to_numpy())], ["row", "step", "item"])


def _semi_join(source: DataFrame, keys, frequent: DataFrame, lookup: int) -> DataFrame:
    """The occurrences of frequent phrases, numbered and written."""
    if frequent.limit(lookup + 1).count() <= lookup:
        wanted = np.sort(frequent.select("key").toArrow().column("key").to_numpy())
        shared = source.sparkSession.sparkContext.broadcast(wanted)
        return settle(source.mapInArrow(_number(keys, shared), RELATION))
    each = source.mapInArrow(keys, PLACED).select("row", F.explode(F.arrays_zip("at", "key")).alias("o")).select("row", "o.at", "o.key")
    kept = each.join(frequent.select("key", "id"), "key").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("o"))
    return settle(kept.select("row", F.col("o.at").alias("at"), F.col("o.id").alias("item")).mapInArrow(_repack, RELATION))


def _numbered(counts: DataFrame) -> DataFrame:
    """(key, n, ..., id) with dense ids from 0 in the order of keys."""
    out = settle(row_index(counts, ["key"], "id").withColumn("id", F.col("id") - 1))
    if out.where(f"id >= {1 << 31}").limit(1).count():
        raise ValueError("more than 2^31 frequent phrases of one length; raise least")
    return out


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, max_words: int = 3, least: int = 10, lookup: int = LOOKUP) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, a, longer), (lang, n)): every phrase of up to ``max_words`` words with a >= least occurrences
    inside pieces, the highest count of a phrase one word longer that it lies in (null if none), and all words of a language."""
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), lang.alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(freeing(_count_words), "lang string, word string, key long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
    counted = settle(counted)
    if counted.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("two words share a 64-bit hash; change the multiplier of words.py")
    total = settle(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    level = _numbered(counted.where(F.col("n") >= least))
    named = level.select("id", "lang", F.col("word").alias("phrase"), "n", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"))
    source, keys, out = texts, _first_keys, []
    for k in range(1, max_words + 1):
        out.append((k, named))
        if k == max_words:
            break
        source, keys = _semi_join(source, keys, level, lookup), _joined
        counts = source.mapInArrow(_tally(keys), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        level = _numbered(counts)
        sides = level.select("id", "n", F.shiftrightunsigned("key", 32).alias("left"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("right"))
        first = named.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"))
        last = named.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("tail"))
        named = settle(sides.join(first, "left").join(last, "right").select("id", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "n", "left", "right"))
    every = None
    for i, (k, part) in enumerate(out):
        if i + 1 < len(out):
            longer = out[i + 1][1]
            over = longer.select(F.col("left").alias("id"), "n").union(longer.select("right", "n")).groupBy("id").agg(F.max("n").alias("longer"))
            part = part.join(over, "id", "left")
        else:
            part = part.withColumn("longer", F.lit(None).cast("long"))
        part = part.select("lang", F.lit(k).alias("words"), "phrase", F.col("n").alias("a"), "longer")
        every = part if every is None else every.union(part)
    return every, total


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *,
    max_words: int = 3, least: int = 10, first: int = 2000, covered: int = 50, scale: int = 1_000_000, lookup: int = LOOKUP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` best phrases of 2 to ``max_words`` words.

    A word is a run of anything but spaces and tabs, A-Z as a-z, in a piece between ``.,;:!?`` and line ends; a null
    language is ``und``, a null or empty text has no words, repeated rows count each time. a is the phrase's count (``least`` or more),
    l and r those of its two parts at the cut with the lowest floor(scale * a * a / (l * r)), the
    earliest of equals; n is the language's count of words. A phrase goes if a longer one of up to
    ``max_words`` words that contains it has ``covered`` percent or more of its count. As a longer phrase's counts never exceed those of the
    phrases in it, one word more is enough to look at. Ties in score go to the larger a, then the smaller phrase by its bytes.
    An empty table gives no rows.
    """
    every, total = phrases(docs, text_col, lang_col, max_words=max_words, least=least, lookup=lookup)
    every = settle(every)
    kept = every.where("words > 1").where(f"longer is null or 100 * longer < {covered} * a")
    w = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", "a", w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("head"), F.expr("array_join(slice(w, cut + 1, size(w) - cut), ' ')").alias("rest"))
    part = lambda side, name: every.select("lang", F.col("phrase").alias(side), F.col("a").cast("decimal(15,0)").alias(name))
    both = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr(f"(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * {scale}) div (l * r)")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = best.select("lang", "phrase", "a", F.col("c.l").cast("long").alias("l"), F.col("c.r").cast("long").alias("r"), F.col("c.score").alias("score"))
    top = top.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= first)
    return top.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
