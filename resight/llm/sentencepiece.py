"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The pass goes over the byte positions of a text. A position is reached by the pieces that end
there; each keeps a back pointer, and only the last maximum-piece-length positions can still be
extended. Where the backpointer paths of all of them meet in one boundary the ids before it are
final and are given out, so the window is bounded whatever the text's length.

The given vocabulary is of the merging kind (its scores are merge ranks), so the sum of scores
is not what its own library maximises. Here the lattice decides instead: a step from piece
x to piece y survives only if merging the letters of x y leaves exactly x and y (``admitted``). Then one
path survives to every position, and the ids are those of the merges.

No piece has a blank after a letter, so all paths meet at every run of blanks. Most of the work is
therefore done for the distinct blank-led segments of a chunk of text, in lockstep over array
columns; a segment beyond ``LOCKSTEP`` bytes takes the scalar pass with its bounded window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from resight.llm.words import _BYTE, U, chunks, mix, narrow, release, split, _powers

LOCKSTEP = 64
#: Segments that advance together.
LANES = 5_000
#: Segments, and pairs of pieces, that a task remembers; a segment's ids are kept as bytes.
CACHE = 200_000
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[32] = False


class Vocabulary:
    """Pieces, merges and byte fallbacks of a model file, as arrays of bounded size."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        name = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any("\u2581" in name[i].lstrip("\u2581") for i in plain):
            raise ValueError("pieces with a blank after a letter are not supported")
        self.size = n
        self.unknown = n  # stands for a letter without a piece
        self.fallback = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        if (self.fallback == sp.unk_id()).any():
            raise ValueError("a model with byte pieces is needed")
        text = {i: name[i].replace("\u2581", " ") for i in plain}
        ids = {t: i for i, t in text.items()}
        rank = {i: -sp.get_score(i) for i in plain}
        self.rank = np.full(n + 1, -1, dtype=np.int64)
        self.left = np.full(n + 1, -1, dtype=np.int64)
        self.right = np.full(n + 1, -1, dtype=np.int64)
        reached = []
        for i in plain:
            t = text[i]
            if len(t) == 1:
                reached.append(i)
                continue
            self.rank[i] = round(rank[i])
            last = _merge(t, ids, rank)
            if last is not None:
                self.left[i], self.right[i] = last
                reached.append(i)
        ok = set(reached)
        merges = []
        for i in plain:
            t = text[i]
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a in ok and b in ok:
                    merges.append((a * (n + 1) + b, i))
        merges.sort()
        self.pair = np.array([m for m, _ in merges], dtype=np.int64)
        self.merged = np.array([z for _, z in merges], dtype=np.int64)
        self.pair_seen = _flags(mix(self.pair.view(U)))
        raw = [text[i].encode() for i in reached]
        h = _hash_all(raw)
        order = np.argsort(h)
        self.hash, self.id = h[order], np.array(reached, dtype=np.int64)[order]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.seen = _flags(self.hash)
        self.lengths = sorted({len(r) for r in raw}, reverse=True)
        self.longest = self.lengths[0]
        out = [text[i].encode() if i in text else b"" for i in range(n)]
        for b, i in enumerate(self.fallback):
            out[i] = bytes([b])
        self.bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        at = np.flatnonzero(self.seen[(h >> U(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        hit = self.hash[k] == h[at]
        out[at[hit]] = self.id[k[hit]]
        return out

    def merge(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The piece that x and y merge into, or -1."""
        key = x * (self.size + 1) + y
        out = np.full(len(x), -1, dtype=np.int64)
        at = np.flatnonzero(self.pair_seen[(mix(key.view(U)) >> U(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.pair, key[at]), len(self.pair) - 1)
        hit = self.pair[k] == key[at]
        out[at[hit]] = self.merged[k[hit]]
        return out

    def admitted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the merges of the letters of x y end in exactly x and y.

        The two borders are taken apart again, latest merge first. At each moment the two symbols
        at the border must not merge before the merge that in truth takes up either.
        """
        ok = np.ones(len(x), dtype=bool)
        live = np.arange(len(x))
        x, y = x.astype(np.int64), y.astype(np.int64)
        never = np.iinfo(np.int64).max
        until_x, until_y = np.full(len(x), never), np.full(len(x), never)
        while len(live):
            z = self.merge(x, y)
            r = self.rank[z]
            # of equal merges the left one comes first
            bad = (z >= 0) & (r < until_x) & ((r < until_y) | ((r == until_y) & (until_y < never)))
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            take_x = rx > ry
            go = ~bad & (np.maximum(rx, ry) >= 0)
            nx, ny = np.where(take_x, self.right[x], x), np.where(take_x, y, self.left[y])
            until_x, until_y = np.where(take_x, rx, until_x)[go], np.where(take_x, until_y, ry)[go]
            x, y, live = nx[go], ny[go], live[go]
        return ok


def _merge(t: str, ids: dict, rank: dict):
    """The two pieces that merge last into t, or None where merging its letters does not end in t."""
    parts, last = list(t), None
    while len(parts) > 1:
        best = None
        for k in range(len(parts) - 1):
            i = ids.get(parts[k] + parts[k + 1])
            if i is not None and (best is None or rank[i] < best[0]):
                best = (rank[i], k)
        if best is None:
            return None
        k = best[1]
        last = (ids.get(parts[k]), ids.get(parts[k + 1]))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return last if last and None not in last else None


def _flags(h: np.ndarray) -> np.ndarray:
    f = np.zeros(1 << 20, dtype=bool)
    f[(h >> U(44)).astype(np.int64)] = True
    return f


def _hash_all(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    power, inverse = _powers(len(data))
    total = np.concatenate([[U(0)], np.cumsum(_BYTE[data] * power[: len(data)], dtype=U)])
    return mix((total[at[1:]] - total[at[:-1]]) * inverse[at[:-1]])


def _letter_end(data: np.ndarray) -> np.ndarray:
    """Length of the letter that starts at each byte; 0 inside a letter."""
    return np.where(data < 0x80, 1, np.where(data < 0xC0, 0, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))))


def _lockstep(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Ids of short segments, all advanced together by one byte position at a time."""
    n, size = len(words), np.array([len(w) for w in words])
    top = int(size.max())
    data = np.zeros((n, top), dtype=np.uint8)
    data[np.arange(top) < size[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
    power, inverse = _powers(top)
    total = np.zeros((top + 1, n), dtype=U)
    np.cumsum(_BYTE[data.T] * power[:top, None], axis=0, dtype=U, out=total[1:])
    letter = _letter_end(data).T
    token = np.full((top + 1, n), -1, dtype=np.int64)
    back = np.zeros((top + 1, n), dtype=np.int64)
    token[0] = v.unknown
    for p in range(1, top + 1):
        open_ = size >= p
        for k in v.lengths:
            if k > p:
                continue
            at = np.flatnonzero(open_ & (token[p - k] >= 0))
            if not len(at):
                continue
            piece = v.lookup(mix((total[p, at] - total[p - k, at]) * inverse[p - k]))
            if k <= 4:
                piece[(piece < 0) & (letter[p - k, at] == k)] = v.unknown
            hit = piece >= 0
            at, piece = at[hit], piece[hit]
            if not len(at):
                continue
            if p > k:
                good = v.admitted(token[p - k, at], piece)
                at, piece = at[good], piece[good]
            token[p, at], back[p, at] = piece, p - k
            open_[at] = False
    # walk back from every end at once
    out: list[list[int]] = [[] for _ in range(n)]
    at, row = size.copy(), np.arange(n)
    if (token[at, row] < 0).any():
        raise ValueError("a segment has no admitted path")
    while len(row):
        for r, t, b, e in zip(row.tolist(), token[at, row].tolist(), back[at, row].tolist(), at.tolist()):
            if t == v.unknown:
                out[r].extend(int(v.fallback[x]) for x in words[r][b:e][::-1])
            else:
                out[r].append(t)
        at = back[at, row]
        go = at > 0
        at, row = at[go], row[go]
    return [np.array(x[::-1], dtype=np.int32) for x in out]


def stream_ids(v: Vocabulary, data: bytes, memo: dict):
    """Ids of one segment of any length, given out as soon as all surviving paths agree on them."""
    table = memo.setdefault("pieces", {v.bytes[v.at[i] : v.at[i + 1]].tobytes(): int(i) for i in v.id})
    sizes, longest = v.lengths, v.longest
    nodes = {0: (None, v.unknown, 0)}  # position: (parent node, piece, position)
    done = 0

    def path(node, stop):
        out = []
        while node[2] > stop:
            out.append(node)
            node = node[0]
        return out[::-1]

    def ids(steps):
        for node in steps:
            if node[1] == v.unknown:
                yield from (int(v.fallback[x]) for x in data[node[0][2] : node[2]])
            else:
                yield node[1]

    for p in range(1, len(data) + 1):
        for k in sizes:
            parent = nodes.get(p - k)
            if parent is None:
                continue
            piece = table.get(data[p - k : p])
            if piece is None:
                if k > 4 or _letter_end(np.frombuffer(data[p - k : p - k + 1], np.uint8))[0] != k:
                    continue
                piece = v.unknown
            if p > k:
                pair = (parent[1], piece)
                if pair not in memo:
                    memo[pair] = bool(v.admitted(np.array([pair[0]]), np.array([pair[1]]))[0])
                if not memo[pair]:
                    continue
            nodes[p] = (parent, piece, p)
            break
        nodes.pop(p - longest - 1, None)
        if p % 256 == 0:
            # the boundaries on every survivor's path; the last one is final
            common = None
            for node in nodes.values():
                at = {x[2] for x in path(node, done)}
                common = at if common is None else common & at
            if common:
                last = max(common)
                some = next(x for x in path(nodes[max(nodes)], done) if x[2] == last)
                yield from ids(path(some, done))
                # the final part is let go: its node becomes a root
                root = {}
                for node in list(nodes.values()):
                    steps = path(node, last)
                    prev = root.setdefault("at", (None, some[1], last))
                    for x in steps:
                        prev = root.setdefault((x[2], x[1], prev[2]), (prev, x[1], x[2]))
                    nodes[node[2]] = prev
                done = last
    if len(data) not in nodes:
        raise ValueError("the text has no admitted path")
    yield from ids(path(nodes[len(data)], done))


class Encoder:
    """Encodes chunks of rows; segments met before come from a bounded memory."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.memo = v, {}, {}

    def chunk(self, c) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk, and each row's first (and the count of all)."""
        # the mark for a blank counts as a blank
        w = split(c, NOT_BLANK, lower=False)
        rows = len(c.offsets) - 1
        first, last = w.first[:-1], w.first[1:]
        has = last > first
        before = np.empty(len(w.start), np.int64)
        before[1:] = w.end[:-1]
        before[first[has]] = c.offsets[:-1][has] - 1  # every text is led by one blank more
        blanks = w.start - before
        # blanks at the end of a row, or a row of blanks only, are segments without letters
        end = np.where(has, w.end[np.maximum(last - 1, 0)] if len(w.end) else 0, c.offsets[:-1] - 1)
        tail = np.flatnonzero((c.offsets[1:] > end) & (c.offsets[1:] > c.offsets[:-1]))
        key = np.concatenate([mix(w.hash + blanks.astype(U) * U(0x9E3779B97F4A7C15)), mix((c.offsets[1:] - end)[tail].astype(U) * U(0x9E3779B97F4A7C15))])
        row = np.concatenate([w.row, tail])
        start = np.concatenate([w.start, c.offsets[1:][tail]])
        stop = np.concatenate([w.end, c.offsets[1:][tail]])
        blanks = np.concatenate([blanks, (c.offsets[1:] - end)[tail]])
        order = np.argsort(row, kind="stable")
        unique, where, inverse = np.unique(key[order], return_index=True, return_inverse=True)
        ids = self._segments(unique.tolist(), order[where], c.data, start, stop, blanks)
        size = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        flat, at = np.frombuffer(b"".join(ids), np.int32), np.concatenate([[0], np.cumsum(size)])
        n = size[inverse]
        take = np.repeat(at[inverse] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        count = np.bincount(row[order], n, minlength=rows).astype(np.int64)
        return flat[take], np.concatenate([[0], np.cumsum(count)])

    def _segments(self, keys, where, data, start, stop, blanks):
        if len(self.known) > CACHE:
            self.known.clear()
        out = [self.known.get(k) for k in keys]
        todo = [i for i, x in enumerate(out) if x is None]
        raw = {i: b" " * int(blanks[where[i]]) + data[start[where[i]] : stop[where[i]]].tobytes() for i in todo}
        todo.sort(key=lambda i: len(raw[i]))
        short = [i for i in todo if len(raw[i]) <= LOCKSTEP]
        for lo in range(0, len(short), LANES):
            part = short[lo : lo + LANES]
            for i, x in zip(part, _lockstep(self.v, [raw[i] for i in part])):
                out[i] = self.known[keys[i]] = x.astype(np.int32, copy=False).tobytes()
        if len(self.memo) > CACHE:
            self.memo.clear()
        for i in todo[len(short) :]:
            out[i] = np.fromiter(stream_ids(self.v, raw[i], self.memo), dtype=np.int32).tobytes()
        return out


def _encode(shared):
    def run(batches):
        enc = Encoder(shared.value)
        for b in batches:
            for c in chunks(b.column("text")):
                ids, first = enc.chunk(c)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(c.lo, c.hi - c.lo), b.column("text").slice(c.lo, c.hi - c.lo), pa.ListArray.from_arrays(first.astype(np.int32), pa.array(ids))],
                    ["id", "text", "ids"],
                )
        del enc
        release()

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return narrow(docs, id_col, text_col).withColumn("text", F.replace("text", F.lit("\u2581"), F.lit(" ")))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids) of every row; the model file's path must hold on all machines that build the session.

    Null and empty texts have no ids. Rows that repeat, and rows with a null id, are encoded like
    others. U+2581 in a text counts as a blank, as in the model's own library.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    return _rows(docs, id_col, text_col).mapInArrow(_encode(shared), "id long, text string, ids array<int>")


def _decode(shared, keep: list[str]):
    """Batches with ids -> (decoded, then the columns ``keep``)."""

    def run(batches):
        v = shared.value
        for b in batches:
            ids = b.column("ids")
            if ids.null_count:
                ids = pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int32()))
            first = ids.offsets.to_numpy().astype(np.int64)
            flat = ids.values.to_numpy(zero_copy_only=False)
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + (1 << 19), side="right")) - 1)
                part = flat[first[lo] : first[hi]]
                n = v.at[part + 1] - v.at[part]
                ends = np.concatenate([[0], np.cumsum(n)])
                data = v.bytes[np.repeat(v.at[part] - ends[:-1], n) + np.arange(ends[-1])]
                at = ends[first[lo : hi + 1] - first[lo]]
                # without the blank that led the text
                keep_byte = np.ones(len(data), bool)
                keep_byte[at[:-1][at[1:] > at[:-1]]] = False
                at = at - np.concatenate([[0], np.cumsum(at[1:] > at[:-1])])
                text = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[keep_byte]))
                yield pa.RecordBatch.from_arrays([text, *(b.column(c).slice(lo, hi - lo) for c in keep)], ["decoded", *keep])
                lo = hi
        release()

    return run


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` and the decoded text of every row; null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))
    slim = encoded.select(F.col(ids_col).alias("ids"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    kinds = [f.dataType.simpleString() for f in slim.schema.fields[1:]]
    out = slim.mapInArrow(_decode(shared, [f"keep_{i}" for i in range(len(keep))]), ", ".join(["decoded string", *(f"keep_{i} {k}" for i, k in enumerate(kinds))]))
    return out.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "decoded")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids, decoded) of every row: ``decode`` of ``encode``, in one worker for each task instead of two with a vocabulary each."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    there, back = _encode(shared), _decode(shared, ["id", "text", "ids"])
    out = _rows(docs, id_col, text_col).mapInArrow(lambda batches: back(there(batches)), "decoded string, id long, text string, ids array<int>")
    return out.select("id", "text", "ids", "decoded")
