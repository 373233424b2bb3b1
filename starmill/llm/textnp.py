"""Vectorised text primitives shared by the Arrow-based operators.

Every function works on one *chunk*: the UTF-8 bytes of several documents back to
back plus their offsets.  Chunks are bounded in bytes (a document longer than the
bound is a chunk of its own), so memory follows the longest document and not the
Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit constants; the same on every machine."""
    base = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)
    return mix64(base) | U64(1)


BYTE_CODE = constants(256, 11)
BASE = U64(0x5851F42D4C957F2D)
_powers = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1024), BASE, dtype=U64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if column.type != pa.large_string() else column
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        lo, hi = offsets[first], offsets[end]
        yield first, end, raw[lo:hi], offsets[first : end + 1] - lo
        first = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] |= 32
    return out


def is_blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


_alnum = np.zeros(256, dtype=bool)
_alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def is_separator(data: np.ndarray) -> np.ndarray:
    """Everything but ASCII letters, digits and non-ASCII bytes."""
    return ~_alnum[data]


@dataclass
class Words:
    """Words of a chunk: document of each, byte range, hash; first[d]:first[d + 1] are those of document d."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray | None = None) -> Words:
    """Maximal runs of non-blank bytes; a document's end also ends a word."""
    n = len(data)
    blank = is_blank(data) if blank is None else blank
    solid = ~blank
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begins = solid.copy()
    begins[1:] &= blank[:-1] | cut[1:n]
    ends = solid.copy()
    ends[:-1] &= blank[1:] | cut[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    size = end - start
    if len(start):
        code = BYTE_CODE[data[solid]]
        at = np.zeros(len(size), dtype=np.int64)
        np.cumsum(size[:-1], out=at[1:])
        code *= powers(int(size.max()))[np.arange(len(code)) - np.repeat(at, size)]
        hashed = mix64(np.add.reduceat(code, at))
    else:
        hashed = np.zeros(0, dtype=U64)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(doc, start, end, hashed, first)


def grams(w: Words, n: int, seed: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of n words inside one document."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    mult = constants(n, seed)
    acc = np.zeros(total - n + 1, dtype=U64)
    for i in range(n):
        acc += w.hash[i : total - n + 1 + i] * mult[i]
    at = np.flatnonzero(w.doc[: total - n + 1] == w.doc[n - 1 :])
    return mix64(acc[at]), at


def distinct_per_doc(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (doc, value) pairs."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]
