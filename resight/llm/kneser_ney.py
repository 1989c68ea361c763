"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from memory-mapped arrays.

Counting. Tasks turn their texts into sorted distinct (history, word) hash pairs with counts, packed
by history, and send them in blocks to ``parts`` ranges of the history's hash. Histories that make
up more than 1/5000 of all tokens (fewer than 5000 words by definition) are dealt by the pair
instead, so no frequent word gathers its followers in one task. Each range adds up its pairs, writes them as a
sorted hash array with counts, and passes on partial figures for each history (how many
followers occur once, twice, more often) and each word (how many histories it follows). A last
step joins these with the words' counts, range by range, into one sorted array of words.

Storage. The arrays are .npy files in the shared folder, one set for each range. Workers map them
into memory, so only pages that are looked up are read and all workers of a machine share them; from a
store that can't be mapped, files are copied to the worker's own folder once.

The model: P(w | u) = max(c(uw) - D(c), 0) / c(u) + g(u) P(w), with three discounts from the
counts of counts; P(w) is the same over numbers of histories, and ends in 1 / (V + 1). A
text starts after a mark and closes with an end token. Word counts are kept by 64-bit hashes,
pairs by two 48-bit ones.
"""

from __future__ import annotations

import io
import tempfile
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from resight.llm.words import NOT_SPACE, U, chunks, mix, narrow, split
from resight.session import new_folder, settle

BUFFER = 4_000_000
RANGE_CHARS = 32 << 20
HOT = 5_000
END, BEGIN = U(0x1F0D5A7E3C2B4961), U(0x7B19E4C2D6A85F03)
BLOCK = "part int, kind int, block binary"


class Model(NamedTuple):
    folder: str
    parts: int
    hot: np.ndarray  # histories dealt by pair, 48 bits
    tokens: int  # N
    words: int  # V
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    low_total: int
    low_rest: float
    texts: int
    begin_rest: float  # discounted mass after the mark


def _six(x: np.ndarray) -> bytes:
    """The upper 48 bits of each value."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(block: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(block)) as z:
        return {k: z[k] for k in z.files}


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, 2:] = raw.reshape(-1, 6)
    return out.view("<u8").ravel().astype(U) >> U(16)


def _slim_counts(c: np.ndarray) -> np.ndarray:
    return c.astype(np.uint8 if not len(c) or c.max() < 256 else np.uint32)


def _range(h: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Range of a hash of so many bits; parts is a power of two."""
    return (h >> U(bits - int(parts).bit_length() + 1)).astype(np.int64)


def _owner(u: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """Range of each pair of 48-bit hashes."""
    at = np.minimum(np.searchsorted(hot, u), max(len(hot) - 1, 0))
    is_hot = hot[at] == u if len(hot) else np.zeros(len(u), bool)
    return np.where(is_hot, _range(mix(u * U(0x9E3779B97F4A7C15) + w), parts, 64), _range(u, parts, 48))


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * U(0xC2B2AE3D27D4EB4F) ^ mix(w + U(0x165667B19E3779F9)))


def _tokens(c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history, word, row) of every token of a chunk, the end tokens included; 64-bit hashes."""
    w = split(c, NOT_SPACE)
    rows = len(c.offsets) - 1
    n = np.diff(w.first) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    word = np.full(first[-1], END, dtype=U)
    inside = np.ones(first[-1], dtype=bool)
    inside[first[1:] - 1] = False
    word[inside] = w.hash
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[first[:-1]] = BEGIN
    return history, word, np.repeat(np.arange(rows), n)


def _sum_by(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[at], *(np.add.reduceat(c[order], at) if len(at) else c for c in counts)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, block = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.binary())], ["part", "kind", "block"])


def _slices(part: np.ndarray, parts: int):
    """(range, where its rows are) of sorted range numbers."""
    edge = np.searchsorted(part, np.arange(parts + 1))
    return [(p, slice(edge[p], edge[p + 1])) for p in range(parts) if edge[p + 1] > edge[p]]


def _count_words(parts):
    def run(batches):
        def flush():
            w, c = _sum_by(np.concatenate(held), np.ones(sum(map(len, held)), np.int64))
            return _batch([(p, 0, _pack(w=w[s], c=_slim_counts(c[s]))) for p, s in _slices(_range(w, parts, 64), parts)])

        held: list[np.ndarray] = []
        for b in batches:
            for c in chunks(b.column("text")):
                held.append(_tokens(c)[1])
                if sum(map(len, held)) > BUFFER:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return run


def _add_words(key, pdf):
    import pandas as pd

    got = [_unpack(x) for x in pdf["block"]]
    w, c = _sum_by(np.concatenate([g["w"] for g in got]), np.concatenate([g["c"].astype(np.int64) for g in got]))
    total = _pack(words=np.array([len(w)]), tokens=np.array([c.sum()]))
    return pd.DataFrame({"part": [key[0]] * 2, "kind": [0, 1], "block": [_pack(w=w, c=_slim_counts(c)), total]})


def _frequent(least):
    def run(batches):
        for b in batches:
            for x in b.column("block").to_pylist():
                g = _unpack(x)
                yield pa.RecordBatch.from_arrays([pa.array((g["w"][g["c"] > least] >> U(16)).view(np.int64))], ["u"])

    return run


def _count_pairs(parts, shared):
    def run(batches):
        hot = shared.value

        def flush():
            u, w = np.concatenate(held_u), np.concatenate(held_w)
            order = np.lexsort((w, u))
            u, w = u[order], w[order]
            at = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
            c = np.diff(np.append(at, len(u)))
            u, w = u[at], w[at]
            owner = _owner(u, w, hot, parts)
            order = np.argsort(owner, kind="stable")
            u, w, c, owner = u[order], w[order], c[order], owner[order]
            rows = []
            for p, s in _slices(owner, parts):
                first = np.flatnonzero(np.append(True, u[s][1:] != u[s][:-1]))
                rows.append((p, 0, _pack(
                    u=np.frombuffer(_six(u[s][first] << U(16)), np.uint8), n=np.diff(np.append(first, s.stop - s.start)).astype(np.uint32),
                    w=np.frombuffer(_six(w[s] << U(16)), np.uint8), c=_slim_counts(c[s]),
                )))
            return _batch(rows)

        held_u: list[np.ndarray] = []
        held_w: list[np.ndarray] = []
        for b in batches:
            for c in chunks(b.column("text")):
                u, w, _ = _tokens(c)
                held_u.append(u >> U(16))
                held_w.append(w >> U(16))
                if sum(map(len, held_u)) > BUFFER:
                    yield flush()
                    held_u.clear()
                    held_w.clear()
        if held_u:
            yield flush()

    return run


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all: a task that runs again puts the same file in place."""
    store, path = _open(folder)
    out = io.BytesIO()
    np.save(out, array)
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(out.getbuffer())
    store.move(draft, f"{path}/{name}")


def _add_pairs(folder, parts):
    def run(key, pdf):
        import pandas as pd

        us, ws, cs = [], [], []
        for x in pdf["block"]:
            g = _unpack(x)
            us.append(np.repeat(_from_six(g["u"]), g["n"]))
            ws.append(_from_six(g["w"]))
            cs.append(g["c"].astype(np.int64))
        u, w, c = np.concatenate(us), np.concatenate(ws), np.concatenate(cs)
        order = np.lexsort((w, u))
        u, w, c = u[order], w[order], c[order]
        at = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
        u, w, c = u[at], w[at], np.add.reduceat(c, at)
        k = _pair(u, w)
        order = np.argsort(k)
        _save(folder, f"pair-{key[0]}.npy", k[order])
        _save(folder, f"count-{key[0]}.npy", c[order].astype(np.uint32 if c.max() >= 65536 else np.uint16 if c.max() >= 256 else np.uint8))
        rows = [(key[0], 2, _pack(n=np.array([(c == i).sum() for i in (1, 2, 3, 4)])))]
        hu, n1, n2, n3 = _sum_by(u, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))
        rows += [(p, 3, _pack(u=hu[s], n1=_slim_counts(n1[s]), n2=_slim_counts(n2[s]), n3=_slim_counts(n3[s]))) for p, s in _slices(_range(hu, parts, 48), parts)]
        cw, n = _sum_by(w, np.ones(len(w), np.int64))
        rows += [(p, 4, _pack(w=np.frombuffer(_six(cw[s] << U(16)), np.uint8), n=_slim_counts(n[s]))) for p, s in _slices(_range(cw, parts, 48), parts)]
        return pd.DataFrame(rows, columns=["part", "kind", "block"])

    return run


def _finish(folder, discounts):
    def run(key, pdf):
        import pandas as pd

        got: dict[int, list[dict]] = {0: [], 3: [], 4: []}
        for kind, x in zip(pdf["kind"], pdf["block"]):
            got[kind].append(_unpack(x))
        # the mark before a text is a history, but no word
        w = np.concatenate([*(g["w"] for g in got[0]), np.zeros(0, U)])
        c = np.concatenate([*(g["c"].astype(np.int64) for g in got[0]), np.zeros(0, np.int64)])
        rest, kept = np.zeros(len(w)), np.zeros(len(w), np.int64)
        short = w >> U(16)
        begin = None
        if got[3]:
            u, *n = _sum_by(np.concatenate([g["u"] for g in got[3]]), *(np.concatenate([g[f"n{i}"].astype(np.int64) for g in got[3]]) for i in (1, 2, 3)))
            mass = sum(d * x for d, x in zip(discounts, n))
            at = np.minimum(np.searchsorted(u, short), len(u) - 1)
            ok = u[at] == short
            rest[ok] = mass[at[ok]]
            mark = np.flatnonzero(u == BEGIN >> U(16))
            begin = float(mass[mark[0]]) if len(mark) else None
        if got[4]:
            v, n = _sum_by(np.concatenate([_from_six(g["w"]) for g in got[4]]), np.concatenate([g["n"].astype(np.int64) for g in got[4]]))
            at = np.minimum(np.searchsorted(v, short), len(v) - 1)
            ok = v[at] == short
            kept[ok] = n[at[ok]]
        for name, x in (("word", w), ("times", c.astype(np.uint32) if not len(c) or c.max() < 1 << 32 else c), ("rest", rest.astype(np.float32)), ("kept", kept.astype(np.uint32))):
            _save(folder, f"{name}-{key[0]}.npy", x)
        stat = _pack(m=np.array([(kept == i).sum() for i in (1, 2, 3, 4)] + [(kept > 2).sum(), kept.sum()]), begin=np.array([-1.0 if begin is None else begin]))
        return pd.DataFrame({"part": [key[0]], "kind": [5], "block": [stat]})

    return run


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things that occur 1, 2, 3, 4 times."""
    n = np.maximum(np.asarray(n, dtype=float), 1)
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(np.clip(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.1, k + 0.9)) for k in range(3))


def _stats(df: DataFrame, kind: int) -> list[dict]:
    return [_unpack(bytes(r.block)) for r in df.where(F.col("kind") == kind).select("block").collect()]


def train(texts: DataFrame, text_col: str = "text", parts: int | None = None) -> Model:
    """The model of all rows of ``texts``; each row is one text, a null one is empty."""
    spark = texts.sparkSession
    texts = texts.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    rows, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if parts is None:
        parts = 1 << max(4, int(chars // RANGE_CHARS).bit_length())
    folder = new_folder(spark, "ngrams")
    words = settle(texts.mapInArrow(_count_words(parts), BLOCK).groupBy("part").applyInPandas(_add_words, BLOCK))
    sums = _stats(words, 1)
    n, v = sum(int(s["tokens"][0]) for s in sums), sum(int(s["words"][0]) for s in sums)
    counted = words.where("kind = 0")
    hot = sorted(r.u for r in counted.select("block").mapInArrow(_frequent(n / HOT), "u long").collect())
    hot = np.array(sorted({*hot, int(BEGIN >> U(16))}), dtype=np.int64).view(U)
    pairs = texts.mapInArrow(_count_pairs(parts, spark.sparkContext.broadcast(hot)), BLOCK)
    partial = settle(pairs.groupBy("part").applyInPandas(_add_pairs(folder, parts), BLOCK))
    d = _discounts(sum(s["n"] for s in _stats(partial, 2)) if rows else np.zeros(4))
    last = settle(counted.union(partial.where("kind > 2")).groupBy("part").applyInPandas(_finish(folder, d), BLOCK))
    ends = _stats(last, 5)
    m = sum((s["m"] for s in ends), np.zeros(6, np.int64))
    low = _discounts(m[:4])
    total = int(m[5])
    rest = (low[0] * m[0] + low[1] * m[1] + low[2] * m[4]) / max(total, 1)
    begin = max([float(s["begin"][0]) for s in ends] + [-1.0])
    return Model(folder, parts, hot, n, v, d, low, total, float(rest), rows, max(begin, 0.0))


_MAPPED: dict[str, dict] = {}


def _mapped(folder: str, name: str):
    """A model file as a read-only memory map, or None where the range is empty."""
    files = _MAPPED.setdefault(folder, {})
    if name not in files:
        from pyarrow import fs

        store, path = _open(folder)
        if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
            files[name] = None
        elif isinstance(store, fs.LocalFileSystem):
            files[name] = np.load(f"{path}/{name}", mmap_mode="r")
        else:
            own = files.setdefault("", tempfile.TemporaryDirectory(prefix="ngrams-"))
            fs.copy_files(f"{path}/{name}", f"{own.name}/{name}", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            files[name] = np.load(f"{own.name}/{name}", mmap_mode="r")
    return files[name]


def _find(folder, key_file, value_files, keys, part, parts):
    """Values of sorted-within-range keys from the files of their ranges; 0 where a key is missing."""
    out = [np.zeros(len(keys), np.float64) for _ in value_files]
    order = np.argsort(part, kind="stable")
    for p, s in _slices(part[order], parts):
        at = order[s]
        table = _mapped(folder, f"{key_file}-{p}.npy")
        if table is None or not len(table):
            continue
        k = np.minimum(np.searchsorted(table, keys[at]), len(table) - 1)
        hit = table[k] == keys[at]
        for o, name in zip(out, value_files):
            o[at[hit]] = _mapped(folder, f"{name}-{p}.npy")[k[hit]]
    return out


def _score(shared):
    def run(batches):
        m = shared.value
        floor = m.low_rest / (m.words + 1) if m.low_total else 1.0 / (m.words + 1)
        for b in batches:
            for c in chunks(b.column("text")):
                u, w, row = _tokens(c)
                words, inverse = np.unique(w, return_inverse=True)
                times, rest, kept = _find(m.folder, "word", ("times", "rest", "kept"), words, _range(words, m.parts, 64), m.parts)
                cut = np.asarray([0, *m.low_discounts])[np.minimum(kept, 3).astype(np.int64)]
                low = (np.maximum(kept - cut, 0) / max(m.low_total, 1) + floor)[inverse]
                # a history's own count; the mark stands before every text, the end before nothing
                at = np.minimum(np.searchsorted(words, u), len(words) - 1)
                mark = u == BEGIN
                n_u = np.where(mark, m.texts, times[at])
                rest_u = np.where(mark, m.begin_rest, rest[at])
                u48, w48 = u >> U(16), w >> U(16)
                pairs, first, back = np.unique(_pair(u48, w48), return_index=True, return_inverse=True)
                (count,) = _find(m.folder, "pair", ("count",), pairs, _owner(u48[first], w48[first], m.hot, m.parts), m.parts)
                seen = count[back]
                cut = np.asarray([0, *m.discounts])[np.minimum(seen, 3).astype(np.int64)]
                known = n_u > 0
                p = np.where(known, (np.maximum(seen - cut, 0) + rest_u * low) / np.maximum(n_u, 1), low)
                base = np.log10((times[inverse] + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
                rows = c.hi - c.lo
                sums = [np.bincount(row, x, minlength=rows) for x in (np.ones(len(row)), (times[inverse] > 0).astype(float), base, np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(c.lo, rows), *(pa.array(x.astype(np.int64)) for x in sums[:2]), pa.array(np.full(rows, m.tokens, np.int64)), *(pa.array(x) for x in sums[2:])],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row, in log10."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return narrow(docs, id_col, text_col).mapInArrow(_score(shared), "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 10) -> DataFrame:
    """Scores of all rows by a model of those outside the held-out fold, with held_out.

    A null text is empty: its end token alone. A null id counts as held out. Rows that repeat are
    counted and scored each. With nothing to learn from every token has probability 1 / (V + 1) = 1.
    """
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("long").cast("string")) % folds, F.lit(0)) == 0
    out = score(docs, train(docs.where(~held), text_col), id_col, text_col)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds, F.lit(0)) == 0
    return out.select("id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
