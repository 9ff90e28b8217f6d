"""Splitting text into the pieces that byte-level BPE merges inside, vectorised over a batch.

Equal to every match of the tokenizers' public pattern: contractions, letters, numbers and other signs with one space
before them, and white space, whose last blank goes to the piece that follows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .textops import hash_spans, text_buffer

_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 4


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point, by Unicode's letters, numbers and white space."""
    out = np.full(0x110000, _OTHER, np.uint8)
    patterns = [(kind, regex.compile(p)) for kind, p in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+"))]
    for a in range(0, 0x110000, 0x2000):  # in parts: little memory in every worker
        points = "".join(map(chr, range(a, a + 0x2000)))
        for kind, pattern in patterns:
            for m in pattern.finditer(points):
                out[a + m.start() : a + m.end()] = kind
    return out


def _byte_classes(raw: np.ndarray) -> np.ndarray:
    """Class of every byte: that of the character it belongs to."""
    table = np.zeros(256, np.uint8)
    table[:128] = _classes()[:128]
    out = table[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        b = raw[lead].astype(np.uint32)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        cp = b & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            at = lead[more] + k
            cp[more] = (cp[more] << 6) | (raw[at] & 0x3F)
        kind = _classes()[cp]
        out[lead] = kind
        for k in (1, 2, 3):
            more = size > k
            out[lead[more] + k] = kind[more]
    return out


class Pretokens:
    """Pieces of a batch: spans in its buffer, hashes, and the piece offsets of its rows."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = text_buffer(column)
        raw, n = self.raw, len(self.raw)
        cls = _byte_classes(raw)
        first = np.ones(n + 1, bool)  # a piece starts here
        if n:
            first[1:n] = cls[1:] != cls[:-1]
            row_start = np.zeros(n + 1, bool)
            row_start[self.offsets] = True
            first |= row_start
            # white space before something else: its last character is apart; a blank joins what follows
            turn = np.flatnonzero(first[1:n] & ~row_start[1:n] & (cls[:-1] == _SPACE)) + 1
            last = turn - 1
            while True:  # back to the first byte of that character
                inside = (raw[last] & 0xC0) == 0x80
                if not inside.any():
                    break
                last = last - inside
            first[last] = True
            first[turn[raw[turn - 1] == 0x20]] = False
            # contractions: an apostrophe that starts a piece and stands alone before letters
            ap = np.flatnonzero((raw == 0x27) & first[:n])
            ap = ap[ap + 1 < n]
            ap = ap[(cls[ap + 1] == _LETTER) & ~row_start[ap + 1]]
            c1 = raw[ap + 1]
            c2 = np.where((ap + 2 < n) & ~row_start[np.minimum(ap + 2, n)], raw[np.minimum(ap + 2, n - 1)], 0)
            one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
            two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
            hit = one | two
            first[ap[hit] + 1] = False
            first[ap[hit] + 2 + two[hit]] |= (ap[hit] + 2 + two[hit] <= n) & True
        self.starts = np.flatnonzero(first[:n])
        self.ends = np.append(self.starts[1:], n) if len(self.starts) else self.starts
        self.rows = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.rows)
        self.hashes = hash_spans(raw, self.starts, self.ends)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first piece of each distinct kind, in their order, and each piece's number among them."""
        _, at, codes = np.unique(self.hashes, return_index=True, return_inverse=True)
        order = np.argsort(at)
        number = np.empty(len(at), np.int64)
        number[order] = np.arange(len(at))
        return at[order], number[codes]

    def piece(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()
