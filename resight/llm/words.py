"""Words, word hashes and shingles of Arrow text columns, computed on byte arrays.

A word is a maximal run of word bytes of the UTF-8 text; A-Z count as a-z. Its hash is a
64-bit polynomial over a random table of byte values, so a chunk of rows is hashed with a
few array passes instead of one Python object for each word. All work goes chunk by chunk:
a chunk holds whole rows of about ``CHUNK`` bytes (a longer row is a chunk of its own, hashed
in pieces), so memory does not follow the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

CHUNK = 1 << 20
#: A chunk's words are found in pieces of so many bytes, whose arrays stay in a processor's own cache.
PIECE = 1 << 16
U = np.uint64


def release() -> None:
    """Gives freed memory back to the machine at the end of a task: a worker serves many stages, and what one leaves counts for the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def freeing(run):
    """A task's function, which gives freed memory back when its batches are through."""

    def then(batches):
        yield from run(batches)
        release()

    return then


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x632BE5AB % (1 << 62)))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: everything but space and the controls 9 to 13.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes: digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_BYTE = stream(1, 256)
_LOWERED = _BYTE[LOWER]
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(PIECE, n)
        _POWERS[:] = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


class Words(NamedTuple):
    hash: np.ndarray  # of each word
    row: np.ndarray  # the row it is in, from 0
    start: np.ndarray  # its bytes
    end: np.ndarray
    first: np.ndarray  # for each row the index of its first word, and the count of all at the end


class Chunk(NamedTuple):
    lo: int  # rows of the batch
    hi: int
    data: np.ndarray  # their bytes
    offsets: np.ndarray  # of each row's first byte, and the length at the end


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Runs of whole rows of about ``limit`` bytes. Null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield Chunk(lo, hi, whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def split(chunk: Chunk, word: np.ndarray, lower: bool = True) -> Words:
    """The words of a chunk, piece by piece."""
    data, offsets = chunk.data, chunk.offsets
    n, parts, at = len(data), [], 0
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            # a cut never goes through a word: back to the last byte between words, or on to the next one
            back = np.flatnonzero(~word[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                while end < n and word[data[end]]:
                    end += 1
        piece = data[at:end]
        inside = word[piece]
        fresh = np.zeros(len(piece) + 1, dtype=bool)
        fresh[-1] = True
        o = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        fresh[o] = True
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | fresh[:-1]))
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
        if len(starts):
            power, inverse = _powers(len(piece))
            total = (_LOWERED if lower else _BYTE)[piece]
            total *= power[: len(piece)]
            np.add.accumulate(total, out=total)
            h = total[ends - 1]
            h[starts > 0] -= total[starts[starts > 0] - 1]
            h *= inverse[starts]
            parts.append((mix(h), starts + at, ends + at))
        at = end
    if parts:
        h, s, e = (np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]
    else:
        h, s, e = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(s, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(h, row, s, e, first)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, row by row, and each row's first (and the count of all).

    A row with fewer words, but not none, has its whole sequence as its one shingle.
    """
    count = np.diff(w.first)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    base = np.repeat(w.first[:-1] - first[:-1], made) + np.arange(first[-1])
    out = np.zeros(first[-1], dtype=U)
    length = np.repeat(np.minimum(count, k), made)
    mul = U(0xD6E8FEB86659FD93)
    for i in range(k):
        use = length > i
        if use.all():
            out = out * mul + w.hash[base + i]
        elif use.any():
            out[use] = out[use] * mul + w.hash[base[use] + i]
    return mix(out + length.astype(U)), first


def openings(c: Chunk, w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` bytes of each word that is longer, and which words these are."""
    at = np.flatnonzero(w.end - w.start > size)
    power, _ = _powers(size)
    h = np.zeros(len(at), dtype=U)
    for j in range(size):
        h += _BYTE[LOWER[c.data[w.start[at] + j]]] * power[j]
    return mix(h + U(size)), at


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, whatever else the table has."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
