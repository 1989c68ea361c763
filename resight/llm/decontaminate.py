"""Benchmark passages in documents, by a prefix-filtered join with exact windows.

An item's windows are all runs of ``window`` consecutive words (an item of fewer words is one
window). A window is a sequence of word shingles; they are ordered by rarity, counted over all
documents, and as containment has to be whole, the rarest one is the necessary prefix. A
document position with that shingle names the windows that may lie there; the offset inside the
window and the two row ends bound where, and every word is then compared. A window whose
prefix occurs nowhere cannot occur and is left out.

The items are the stated query set: they are taken in blocks of at most ``block_words`` words,
each broadcast on its own, so what is sent never grows with the benchmark. Documents are
read twice for each block (to count, to join) and are never shuffled; with more than
one block their hits are merged by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from resight.llm.words import ALNUM, U, Words, chunks, mix, narrow, split
from resight.session import settle

SHINGLE = 3
BLOCK_WORDS = 1_000_000
_MUL = U(0xD6E8FEB86659FD93)
OUT = "key long, id long, n_words long, starts array<long>, ends array<long>, items array<long>"


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, whatever row they are in."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _MUL + h[i : i + n]
    return mix(out + U(k))


class Index:
    """Windows of one block of items: words, shingles, and (once counted) each window's prefix."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        hashes, where, owner, self.length = [], [], [], {}
        at = 0
        w = [(c, split(c, ALNUM)) for c in chunks(pa.array(texts, pa.string()))]
        rows = [x.hash[a:b] for _, x in w for a, b in zip(x.first[:-1], x.first[1:])]
        lengths = []
        for item, h in zip(ids, rows):
            if len(h):
                n = min(window, len(h))
                starts = np.arange(len(h) - n + 1) + at
                where.append(starts)
                lengths.append(np.full(len(starts), n))
                owner += [item] * len(starts)
                hashes.append(h)
                at += len(h)
        self.words = np.concatenate([*hashes, np.zeros(0, U)])
        start, length = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (where, lengths))
        # equal windows are one, with several items
        key = np.zeros(len(start), U)
        for i in range(window):
            use = length > i
            key[use] = key[use] * _MUL + self.words[start[use] + i]
        key = mix(key + length.astype(U))
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.len = start[first], length[first]
        pairs = sorted({(int(g), int(o)) for g, o in zip(group, owner) if o is not None})
        self.item = np.array([o for _, o in pairs], dtype=np.int64)
        self.item_at = np.searchsorted(np.array([g for g, _ in pairs], dtype=np.int64), np.arange(len(first) + 1))
        self.grams = {}
        for k in np.unique(np.minimum(self.len, SHINGLE)):
            k = int(k)
            use = np.flatnonzero(np.minimum(self.len, SHINGLE) == k)
            g = _grams(self.words, k)
            offsets = np.arange(int(self.len[use].max()) - k + 1)
            ok = offsets[None, :] <= (self.len[use] - k)[:, None]
            at = np.where(ok, self.start[use][:, None] + offsets[None, :], self.start[use][:, None])
            self.grams[k] = (use, g[at], ok)

    def tokens(self) -> dict[int, np.ndarray]:
        """The distinct shingles of all windows, by their length, sorted."""
        return {k: np.unique(g[ok]) for k, (_, g, ok) in self.grams.items()}

    def prefixes(self, counts: dict[int, np.ndarray]) -> dict:
        """By shingle length: prefix shingles, and for each the windows that have it and where."""
        out, tokens = {}, self.tokens()
        for k, (use, g, ok) in self.grams.items():
            n = counts[k][np.searchsorted(tokens[k], g)].astype(np.float64)
            n[~ok] = np.inf
            # rarest first; of equally rare ones the smallest hash, then the first
            rank = np.lexsort((np.broadcast_to(np.arange(g.shape[1]), g.shape), g, n), axis=1)[:, 0]
            row = np.arange(len(use))
            live = n[row, rank] > 0
            token, window, offset = g[row, rank][live], use[live], rank[live]
            order = np.argsort(token, kind="stable")
            token, first = np.unique(token[order], return_index=True)
            out[k] = (token, np.append(first, len(order)), window[order], offset[order])
        return out


def _filter(tokens: np.ndarray) -> np.ndarray:
    f = np.zeros(1 << 20, dtype=bool)
    f[(tokens >> U(44)).astype(np.int64)] = True
    return f


def _find(grams: np.ndarray, tokens: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose shingle is one of the sorted tokens, and which."""
    at = np.flatnonzero(seen[(grams >> U(44)).astype(np.int64)])
    if not len(at) or not len(tokens):
        return at[:0], at[:0]
    t = np.minimum(np.searchsorted(tokens, grams[at]), len(tokens) - 1)
    hit = tokens[t] == grams[at]
    return at[hit], t[hit]


def _one_row(w: Words, at: np.ndarray, k: int) -> np.ndarray:
    return w.row[at] == w.row[at + k - 1]


def _count(shared):
    def run(batches):
        tokens, counts, seen = shared.value, {}, {}
        for k, t in tokens.items():
            counts[k], seen[k] = np.zeros(len(t), np.int64), _filter(t)
        for b in batches:
            for c in chunks(b.column("text")):
                w = split(c, ALNUM)
                for k, t in tokens.items():
                    at, which = _find(_grams(w.hash, k), t, seen[k])
                    counts[k] += np.bincount(which[_one_row(w, at, k)], minlength=len(t))
        for k, n in counts.items():
            i = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i), pa.array(n[i])], ["k", "i", "n"])

    return run


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _windows(w: Words, words, start, length, prefixes, seen, most=1 << 20):
    """(first word, window) of every occurrence in a chunk."""
    for k, (token, first, window, offset) in prefixes.items():
        at, which = _find(_grams(w.hash, k), token, seen[k])
        each = first[which + 1] - first[which]
        ends = np.cumsum(each)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            n = each[lo:hi]
            j = np.repeat(first[which[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            win = window[j]
            s = np.repeat(at[lo:hi], n) - offset[j]
            row = np.repeat(w.row[at[lo:hi]], n)
            ok = (s >= w.first[row]) & (s + length[win] <= w.first[row + 1])
            s, win = s[ok], win[ok]
            for i in range(int(length.max())):
                same = (length[win] <= i) | (w.hash[np.minimum(s + i, len(w.hash) - 1)] == words[np.minimum(start[win] + i, len(words) - 1)])
                s, win = s[same], win[same]
            yield s, win
            lo = hi


def _join(shared):
    def run(batches):
        words, start, length, item, item_at, prefixes = shared.value
        seen = {k: _filter(p[0]) for k, p in prefixes.items()}
        for b in batches:
            n_words, hits = [], {}
            for c in chunks(b.column("text")):
                w = split(c, ALNUM)
                n_words.append(np.diff(w.first))
                found = list(_windows(w, words, start, length, prefixes, seen))
                s, win = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
                if not len(s):
                    continue
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + length[win], -1)
                hit = np.cumsum(edge[:-1]) > 0
                row = w.row[s]
                for r in np.unique(row):
                    x, y = _spans(hit[w.first[r] : w.first[r + 1]])
                    own = np.unique(win[row == r])
                    hits[c.lo + int(r)] = (x, y, np.unique(np.concatenate([item[item_at[v] : item_at[v + 1]] for v in own])))
            rows = [hits.get(i) for i in range(b.num_rows)]
            lists = [[() if r is None else r[k] for r in rows] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column("key").cast(pa.int64()), b.column("id").cast(pa.int64()), pa.array(np.concatenate([*n_words, np.zeros(0, np.int64)])), *(pa.array(x, pa.list_(pa.int64())) for x in lists)],
                ["key", "id", "n_words", "starts", "ends", "items"],
            )

    return run


def _merge(batches):
    """Hits of one row from several blocks into one: spans joined, items united."""
    for b in batches:
        out = [[], [], []]
        for s, e, i in zip(*(b.column(k).to_pylist() for k in ("starts", "ends", "items"))):
            spans = sorted(zip((x for y in s for x in y), (x for y in e for x in y)))
            done: list[list[int]] = []
            for x, y in spans:
                if done and x <= done[-1][1]:
                    done[-1][1] = max(done[-1][1], y)
                else:
                    done.append([x, y])
            for k, v in enumerate(([x for x, _ in done], [y for _, y in done], sorted({x for y in i for x in y}))):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_words"), *(pa.array(x, pa.list_(pa.int64())) for x in out)], ["id", "n_words", "starts", "ends", "items"])


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    *, window: int = 10, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, n_words, n_hit, starts, ends, items, contaminated) of every row of docs.

    starts and ends are the maximal runs of hit words, items the sorted ids of items with an
    occurring window. A null or empty text has no words. An item without words has no window; one
    with a null id hits but is not named. Rows that repeat, ids too, are judged each by itself;
    items that repeat are one. Other columns are ignored; no items or no rows give no hits or rows.
    """
    spark = docs.sparkSession
    lines = items.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text"))
    # a block has no more words than characters / 2 + 1
    words = lines.select((F.length("text") / 2 + 1).alias("w")).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    blocks = max(1, int(np.ceil(words / block_words)))
    slim = narrow(docs, id_col, text_col).withColumn("key", F.monotonically_increasing_id() if blocks > 1 else F.lit(0).cast("long"))
    if blocks > 1:
        slim, lines = settle(slim), settle(lines)
    found = None
    for k in range(blocks):
        part = lines.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        index = Index([r.id for r in part], [r.text for r in part], window)
        tokens = index.tokens()
        got = slim.select("text").mapInArrow(_count(spark.sparkContext.broadcast(tokens)), "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect()
        counts = {k: np.zeros(len(t), np.int64) for k, t in tokens.items()}
        for r in got:
            counts[r.k][r.i] = r.n
        shared = spark.sparkContext.broadcast((index.words, index.start, index.len, index.item, index.item_at, index.prefixes(counts)))
        hits = slim.mapInArrow(_join(shared), OUT)
        found = hits if found is None else found.union(hits)
    if blocks > 1:
        found = found.groupBy("key", "id", "n_words").agg(*(F.collect_list(c).alias(c) for c in ("starts", "ends", "items")))
        found = found.mapInArrow(_merge, OUT.replace("key long, ", ""))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("id", "n_words", n_hit.alias("n_hit"), "starts", "ends", "items", (F.size("starts") > 0).alias("contaminated"))
