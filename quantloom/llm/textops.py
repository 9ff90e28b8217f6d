"""Vectorised splitting of Arrow text columns, for use inside Spark's Python tasks.

A batch of texts is one byte buffer.  Splitting marks word bytes, finds the runs, and gives every word a 64-bit hash
from prefix sums, so no Python loop touches a word.  Everything here is a small helper of one batch; Spark partitions
and shuffles the work.  A null text counts as an empty one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once: bounds the memory of the prefix sums (16 bytes a byte of text).
CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


@lru_cache(2)
def _powers(base: int) -> np.ndarray:
    p = np.full(CHUNK + 1, base, dtype=U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which are ascending and may touch but not overlap."""
    out = np.empty(len(starts), U64)
    values, up, down = _byte_values(), _powers(_BASE), _powers(_INVERSE)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + CHUNK, side="right"))
        if j <= i:  # one span longer than a chunk: fold its chunks
            h, a, e = U64(0), at, int(ends[i])
            with np.errstate(over="ignore"):
                while a < e:
                    part = raw[a : min(e, a + CHUNK)]
                    h = h * U64(0xC2B2AE3D27D4EB4F) + (values[part] * up[: len(part)]).sum(dtype=U64)
                    a += CHUNK
            out[i] = h
            i += 1
            continue
        part = raw[at : int(ends[j - 1])]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix64(out)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, none of which crosses a row."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[inner - 1] = mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _table(true: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in true:
        t[a : b + 1] = True
    return t


#: Fixed values of the word contracts: words of letters, digits and non-ASCII bytes; words between ASCII white space.
ALNUM = _table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
SPACED = ~_table([(0x20, 0x20), (0x09, 0x0D)])


@lru_cache(1)
def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _lower()[raw]


class Words:
    """The words of a batch: spans in its buffer, their hashes, and the word offsets of its rows."""

    def __init__(self, column: pa.Array, table: np.ndarray, lower: bool):
        self.raw, self.offsets = text_buffer(column)
        if lower:
            self.raw = lower_ascii(self.raw)
        self.starts, self.ends = runs(table[self.raw], self.offsets)
        self.hashes = hash_spans(self.raw, self.starts, self.ends)
        self.rows = np.searchsorted(self.starts, self.offsets)  # word offsets of the rows
        self.counts = np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width` consecutive word hashes (rows must be told apart by the caller)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = U64(_BASE)
    out = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            out *= base
            out += hashes[k : k + n]
    return mix64(out)


def long_window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """As window_hashes, by doubling: about 2 log2(width) passes instead of width."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, block, size = None, 0, hashes, 1
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                part = block[done : done + n]
                out = part.copy() if out is None else out * U64(0xC2B2AE3D27D4EB4F) + part
                done += size
            left >>= 1
            if left:
                block = mix64(block[:-size] * U64(_BASE) + block[size:])
                size *= 2
    return mix64(out)


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each row, each followed by one space, and the byte offsets of the rows."""
    n, row_of = len(words.counts), words.row_of()
    spread = np.full(len(words.raw) + n, 0x20, np.uint8)  # a spare byte ends every row
    spread[np.arange(len(words.raw)) + np.repeat(np.arange(n), np.diff(words.offsets))] = words.raw
    s, e = (words.starts + row_of)[keep], (words.ends + row_of)[keep]
    spread[e] = 0x20
    mark = np.zeros(len(spread) + 1, np.int8)
    mark[s] = 1
    mark[e + 1] -= 1
    out = spread[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row_of[keep], weights=(e - s + 1), minlength=n).astype(np.int64), out=offsets[1:])
    return out, offsets
