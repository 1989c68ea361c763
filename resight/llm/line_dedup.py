"""Near-duplicate lines by an exact set-similarity join over prefixes of the rarest tokens.

A line's tokens are its distinct word shingles (a line of fewer words is one token). Lines with the same set are one entry, placed where it first
occurs. Tokens have one order for all lines: by rarity, then by hash. Rarity is a count over
all text in a table of ``BUCKETS`` hash buckets, which has a fixed size and can be broadcast; any total
order gives exact results, rarity only keeps lists short. Of n tokens an entry's prefix are the
first n - ceil(t n) + 1; similar entries share a token of their prefixes. Prefixes are written once, in blocks. Their tokens
alone, cut to 48 bits, go to ranges of their hash, which return a bit table of fixed size of those that repeat; only tokens whose bit is set
become rows with their holders (the table thins out; the grouping that follows is exact).
A token's holders are tied to the least of them, for a row each, and all that are tied to one set are its family; a pair with
a common token meets in the family of that token's least holder. Within families sets are compared in order of place, with the length filter and in full (``families``): one that a task can hold
(``MEMBERS`` sets, ``TOKENS`` tokens) in that task, by the prefixes in it, larger
ones by what their lines have over or lack against the family's core, with prefix and position filters on that. A line is
removed if its set occurs earlier, or if an earlier entry matches it; earlier means by document id, then line number.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from resight.llm.families import LEAF, later_in_large, later_in_small, sets_of, sums
from resight.llm.kneser_ney import BLOCK, _batch, _pack, _range, _six, _slices
from resight.llm.substring_dedup import TABLE_BITS, _repeated
from resight.llm.words import ALNUM, U, Chunk, chunks, freeing, mix, narrow, shingles, split
from resight.session import settle, settle_lookup

BUCKETS = 1 << 20
SLICE = 1 << 16
#: A family up to these bounds is compared in one task.
MEMBERS = 1 << 12
TOKENS = 1 << 18
#: Tokens that a task holds before it sends them off, and tokens of all lines for each range of prefix tokens.
BUFFER = 1 << 20
RANGE_TOKENS = 1 << 24


def _lines(c: Chunk) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """The chunk cut at line feeds too, and of each line its row and number in the row."""
    cut = np.flatnonzero(c.data == 10) + 1
    offsets = np.sort(np.concatenate([c.offsets[:-1], cut]))
    row = np.concatenate([np.arange(len(c.offsets) - 1), np.searchsorted(c.offsets, cut - 1, side="right") - 1])
    row = np.sort(row)
    first = np.searchsorted(row, np.arange(len(c.offsets) - 1))
    return Chunk(c.lo, c.hi, c.data, np.append(offsets, len(c.data))), row, np.arange(len(row)) - first[row]


def _short(counts: np.ndarray) -> bytes:
    """Rarity needs no more than 16 bits."""
    return np.minimum(counts, 65_535).astype(np.uint16).tobytes()


def _add_counts(key, pdf):
    import pandas as pd

    total = np.zeros(SLICE, np.int64)
    for x in pdf["counts"]:
        total += np.frombuffer(x, np.uint16)
    return pd.DataFrame({"slice": [key[0]], "counts": [_short(total)]})


def rarity(slices: DataFrame) -> np.ndarray:
    """How often tokens of each hash bucket occur in all texts, up to 65 535, from rows (slice, counts)."""
    got = slices.groupBy("slice").applyInPandas(_add_counts, "slice int, counts binary").collect()
    out = np.zeros(BUCKETS, np.uint16)
    for r in got:
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.uint16)
    return out


def _line_sets(c: Chunk, shingle):
    """(row, number, first, tokens) of a chunk's lines with words: each line's distinct tokens, sorted."""
    cut, row, number = _lines(c)
    h, first = shingles(split(cut, ALNUM), shingle)
    lines = np.flatnonzero(np.diff(first))
    for a, b in zip(first[lines], first[lines + 1]):
        if b - a > 1:
            h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[first[lines]] = True
    at = np.concatenate([[0], np.cumsum(fresh)])[np.append(first[lines], len(h))]
    return row[lines], number[lines], at, h[fresh]


def _sums(at, t):
    """Two 64-bit sums that name each set, as ``families.sums``."""
    return [np.add.reduceat(x, at[:-1]).view(np.int64) if len(at) > 1 else x.view(np.int64) for x in (t, mix(t ^ U(0xA5A5A5A5A5A5A5A5)))]


def prefix_length(n, num: int, den: int):
    """n - ceil(num n / den) + 1."""
    return n - -(-num * n // den) + 1


def _scan(shingle):
    """Lines (id, line, n, s1, s2), and at the end of a task rows (slice, counts) of how often tokens of each hash bucket occur."""

    def run(batches):
        total, held = np.zeros(BUCKETS, np.int64), []
        names = ["id", "line", "n", "s1", "s2", "slice", "counts"]
        for b in batches:
            ids = b.column("id")
            for c in chunks(b.column("text")):
                row, number, at, t = _line_sets(c, shingle)
                held.append((t >> U(44)).astype(np.int32))
                if sum(map(len, held)) > BUFFER:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held.clear()
                lines = [ids.take(pa.array(row + c.lo)), pa.array(number.astype(np.int32)), pa.array(np.diff(at).astype(np.int32)), *(pa.array(x) for x in _sums(at, t))]
                yield pa.RecordBatch.from_arrays([*lines, pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.binary())], names)
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        keep = [k for k in range(0, BUCKETS, SLICE) if total[k : k + SLICE].any()]
        none = [pa.nulls(len(keep), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([k // SLICE for k in keep], pa.int32()), pa.array([_short(total[k : k + SLICE]) for k in keep], pa.binary())], names)

    return run


def _prefixes(order, shingle, num, den):
    """For each chunk of a batch (s1, size, tokens): the rarest tokens of each distinct set, as many as the similarity asks for."""

    def of(b):
        for c in chunks(b.column("text")):
            _, _, at, h = _line_sets(c, shingle)
            n = np.diff(at)
            s1 = _sums(at, h)[0]
            t = (order[(h >> U(44)).astype(np.int64)].astype(U) << U(48)) | (h >> U(16))
            # a set that only an equal one can match has no use for its prefix
            alone = (-(-num * n // den) == n) & ((n + 1) * num > n * den)
            p = np.where(alone, 0, prefix_length(n, num, den))
            first = np.zeros(len(p), bool)
            first[np.unique(s1, return_index=True)[1]] = True
            p[~first] = 0
            for a, e in zip(at[:-1][p > 0], at[1:][p > 0]):
                t[a:e].sort()
            take = np.repeat(at[:-1] - (np.cumsum(p) - p), p) + np.arange(p.sum())
            yield s1[p > 0], p[p > 0].astype(np.int32), t[take].view(np.int64)

    return of


def _blocks(shared, shingle, num, den):
    """A row (sets, sizes, tokens) for each chunk: packed prefixes of its distinct sets."""

    def run(batches):
        of = _prefixes(shared.value, shingle, num, den)
        for b in batches:
            for s, p, t in of(b):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (s, p, t)], ["sets", "sizes", "tokens"])

    return run


def _send(parts):
    """Blocks -> 48 bits of each prefix token's hash, by range; two of each are enough to tell that it repeats."""

    def run(batches):
        def flush():
            v = np.sort(mix(np.concatenate(held)))
            v = v[np.append([True, True], v[2:] != v[:-2])[: len(v)]]
            return _batch([(p, 0, _pack(v=np.frombuffer(_six(v[s]), np.uint8))) for p, s in _slices(_range(v, parts, 64), parts)])

        held: list[np.ndarray] = []
        for b in batches:
            for x in b.column("tokens"):
                held.append(np.frombuffer(x.as_buffer(), U))
                if sum(map(len, held)) > BUFFER:
                    yield flush()
                    held.clear()
        if sum(map(len, held)):
            yield flush()

    return run


def _holders(shared):
    """Blocks -> (token, s1) of the prefixes' tokens whose bit is set."""

    def run(batches):
        bits = shared.value
        for b in batches:
            for sets, sizes, tokens in zip(b.column("sets"), b.column("sizes"), b.column("tokens")):
                t = np.frombuffer(tokens.as_buffer(), np.int64)
                at = (mix(t.view(U)) >> U(64 - TABLE_BITS)).astype(np.int64)
                on = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
                s = np.repeat(np.frombuffer(sets.as_buffer(), np.int64), np.frombuffer(sizes.as_buffer(), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(t[on]), pa.array(s[on])], ["token", "s1"])

    return run


def _bit_table(blocks: DataFrame, parts: int) -> np.ndarray:
    """A table of fixed size with a bit for each prefix token that repeats."""
    got = blocks.select("tokens").mapInArrow(freeing(_send(parts)), BLOCK).groupBy("part").applyInPandas(_repeated(parts), BLOCK).collect()
    out = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    size = len(out) // parts
    for r in got:
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["block"], np.uint8)
    return out


def _take(batches):
    """Texts with a list of lines -> these lines."""
    for b in batches:
        out = []
        for i, text, want in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("want").to_pylist()):
            lines = text.split("\n")
            out += [(w["fam"], w["rep"], w["s1"], i, w["line"], lines[w["line"]]) for w in want if w["line"] < len(lines)]
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["fam", "rep", "s1", "id", "line", "text"])


def _drop(batches):
    """Texts without the lines in ``gone``."""
    for b in batches:
        out, count = [], []
        for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
            lines = (text or "").split("\n")
            count.append(len(lines) if text else 0)
            if gone:
                dead = set(gone)
                text = "\n".join(x for i, x in enumerate(lines) if i not in dead)
            out.append(text)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in b.schema.names if c not in ("text", "gone")), pa.array(out, pa.string()), pa.array(count, pa.int64()), pa.array([len(g or ()) for g in b.column("gone").to_pylist()], pa.int64())],
            [*(c for c in b.schema.names if c not in ("text", "gone")), "text", "n_lines", "n_removed"],
        )


def _families(texts: DataFrame, order: np.ndarray, tokens: int, shingle: int, num: int, den: int) -> DataFrame:
    """(fam, s1) of the sets, named by s1, that share a prefix token with the family's first; ``tokens`` is the number of all lines' tokens."""
    context = texts.sparkSession.sparkContext
    parts = 1 << max(4, int(tokens // RANGE_TOKENS).bit_length())
    blocks = texts.select("text").mapInArrow(freeing(_blocks(context.broadcast(order), shingle, num, den)), "sets binary, sizes binary, tokens binary")
    blocks = settle(blocks)
    held = settle(blocks.mapInArrow(freeing(_holders(context.broadcast(_bit_table(blocks, parts)))), "token long, s1 long"))
    live = held.groupBy("token").agg(F.min("s1").alias("fam"), F.max("s1").alias("last")).where("fam < last").select("token", "fam")
    return held.join(live, "token").select("fam", "s1").distinct()


def matched(docs: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int) -> DataFrame:
    """(id, line) of every line to remove."""
    texts = narrow(docs, id_col, text_col).where("id is not null")
    scanned = settle(texts.mapInArrow(freeing(_scan(shingle)), "id long, line int, n int, s1 long, s2 long, slice int, counts binary"))
    order = rarity(scanned.where("slice is not null").select("slice", "counts"))
    lines = scanned.where("slice is null").select("id", "line", "n", "s1", "s2")
    # equal sets: one entry, at the first of their places
    entries = lines.groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "line")).alias("at"), F.count("*").alias("copies"))
    entries = settle(entries.select(F.monotonically_increasing_id().alias("rep"), "s1", "s2", "n", F.col("at.id").alias("id"), F.col("at.line").alias("line"), "copies"))
    tokens = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = settle(entries.join(_families(texts, order, tokens, shingle, num, den), "s1").select("fam", "rep", "s1", "n", "id", "line"))
    large = members.groupBy("fam").agg(F.count("*").alias("k"), F.sum("n").alias("t")).where(f"k > {LEAF} and (k > {MEMBERS} or t > {TOKENS})")
    large = settle_lookup(large.select("fam", F.lit(True).alias("large")))
    members = members.join(large, "fam", "left")

    def taken(which):
        want = members.where(which).groupBy("id").agg(F.collect_list(F.struct("line", "rep", "fam", "s1")).alias("want"))
        return texts.where("text is not null").join(settle_lookup(want), "id").mapInArrow(freeing(_take), "fam long, rep long, s1 long, id long, line int, text string")

    split_sets = partial(sets_of, shingle=shingle, word=ALNUM)
    late = later_in_small(taken("large is null"), split_sets, num, den)
    if large.limit(1).count():

        def run(batches):
            for b in batches:
                s = list(split_sets(b))
                ok = pa.array([sums(x)[0] == y for x, y in zip(s, b.column("s1").to_pylist())], pa.bool_())
                at = np.concatenate([[0], np.cumsum([len(x) for x in s])]).astype(np.int32)
                flat = np.concatenate([*s, np.zeros(0, U)]).astype(U).view(np.int64)
                out = [b.column("fam"), b.column("rep"), b.column("id"), b.column("line"), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(at, pa.array(flat))]
                yield pa.RecordBatch.from_arrays(out, ["fam", "rep", "id", "line", "n", "d"]).filter(ok)

        sets = taken("large").mapInArrow(run, "fam long, rep long, id long, line int, n long, d array<long>")
        sets = sets.select("fam", "rep", "n", "d", F.struct("id", "line").alias("place")).dropDuplicates(["fam", "rep"])
        late = late.union(later_in_large(settle(sets), num, den))
    late = settle_lookup(late.distinct())
    # what stays of an entry is its first place, unless an earlier entry matches
    marks = entries.join(late.withColumn("late", F.lit(True)), "rep", "left").where("late or copies > 1")
    touched = settle_lookup(marks.select("s1", "s2", "n", F.col("id").alias("fi"), F.col("line").alias("fl"), F.coalesce("late", F.lit(False)).alias("late")))
    return lines.join(touched, ["s1", "s2", "n"]).where("late or id <> fi or line <> fl").select("id", "line").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without later near-duplicate lines, with n_lines (before) and n_removed.

    Every row comes back with all its columns; its text lacks the removed lines. Null and empty texts,
    blank lines and lines without words stay as they are. Rows with a null id take no part.
    Rows that repeat an id are one document: what is removed from line k of one goes from all. An
    empty table gives an empty one. Columns named n_lines or n_removed are replaced.
    """
    gone = matched(docs, id_col, text_col, shingle, num, den).groupBy("id").agg(F.collect_list("line").alias("gone"))
    gone = settle_lookup(gone.withColumnRenamed("id", "gone_id"), 200_000)
    base = docs.drop("n_lines", "n_removed")
    others = [f for f in base.schema.fields if f.name != text_col]
    slim = base.select(*(F.col(f"`{f.name}`").alias(f"keep_{i}") for i, f in enumerate(others)), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias("own_id"))
    slim = slim.join(gone, slim["own_id"] == gone["gone_id"], "left").drop("own_id", "gone_id")
    schema = ", ".join([*(f"keep_{i} {f.dataType.simpleString()}" for i, f in enumerate(others)), "text string, n_lines long, n_removed long"])
    out = slim.mapInArrow(freeing(_drop), schema)
    names = {f.name: f"keep_{i}" for i, f in enumerate(others)} | {text_col: "text"}
    return out.select(*(F.col(names[c]).alias(c) for c in base.columns), "n_lines", "n_removed")
