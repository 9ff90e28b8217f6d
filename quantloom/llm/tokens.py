"""Encoding text batches with the public tokenizers' own libraries, inside Spark's Python tasks.

For a byte-level BPE file the pieces of a batch are found vectorised, and the library's model encodes each distinct piece
once; a worker keeps the ids of pieces it has seen, in sorted hash arrays of bounded size.  Texts that hold one of the
file's special strings, and every text under another kind of tokenizer, go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .pretokens import Pretokens
from .textops import U64

#: Pieces whose ids a worker keeps; beyond it starts anew.
CACHE_PIECES = 3_000_000


def file_digest(path: str) -> str:
    """Digest of a tokenizer file: its version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: b if b in plain else next(rest) for b in range(256)}


class Encoder:
    """Ids of whole texts under one tokenizer file (.json by tokenizers, .model by sentencepiece)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.by_piece = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: model.encode(texts, num_threads=1)
            return
        import tokenizers

        tk = tokenizers.Tokenizer.from_file(path)
        tk.no_padding(), tk.no_truncation()
        self.whole = lambda texts: [x.ids for x in tk.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = spec["model"].get("type") == "BPE" and not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        if plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.by_piece = True
            self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
            self.model, self.letters = tk.model, _byte_letters()
            self._clear()

    def _clear(self):
        self.keys, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _places(self, p: Pretokens) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of every piece in the kept ids, after encoding those not seen before."""
        first, codes = p.distinct()
        keys = p.hashes[first]
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self._clear()
        i = np.searchsorted(self.keys, keys)
        i[i == len(self.keys)] = 0
        new = self.keys[i] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            tokenize, letters = self.model.tokenize, self.letters
            ids = [[t.id for t in tokenize(p.piece(k).decode("latin-1").translate(letters))] for k in first[new].tolist()]
            size = np.array([len(x) for x in ids], np.int32)
            at = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
            self.flat = np.concatenate([self.flat, np.array([t for x in ids for t in x], np.int32)])
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys)
            self.keys, self.at, self.size = all_keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
            i = np.searchsorted(self.keys, keys)
        return self.at[i][codes], self.size[i][codes]

    def _special_rows(self, p: Pretokens) -> np.ndarray:
        raw = p.raw.tobytes()
        rows = [int(np.searchsorted(p.offsets, k, side="right")) - 1 for s in self.special for k in _finds(raw, s)]
        return np.unique(np.array(rows, np.int64))

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.by_piece:
            return np.array([len(x) for x in self.whole([t or "" for t in column.to_pylist()])], np.int64)
        p = Pretokens(column)
        _, size = self._places(p)
        out = np.append(0, np.cumsum(size, dtype=np.int64))[p.rows]
        out = np.diff(out)
        odd = self._special_rows(p)
        if len(odd):
            out[odd] = [len(x) for x in self.whole([column[int(r)].as_py() for r in odd])]
        return out

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of the rows among them."""
        if not self.by_piece:
            return _flat(self.whole([t or "" for t in column.to_pylist()]))
        p = Pretokens(column)
        at, size = self._places(p)
        ends = np.append(0, np.cumsum(size, dtype=np.int64))
        ids = self.flat[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
        off = ends[p.rows]
        odd = self._special_rows(p)
        if len(odd):
            rows = [ids[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            for r, x in zip(odd.tolist(), self.whole([column[int(r)].as_py() for r in odd]), strict=True):
                rows[r] = np.array(x, np.int32)
            return _flat(rows)
        return ids, off


def _flat(rows) -> tuple[np.ndarray, np.ndarray]:
    off = np.append(0, np.cumsum([len(x) for x in rows], dtype=np.int64))
    return (np.concatenate([np.asarray(x, np.int32) for x in rows]) if len(rows) else np.zeros(0, np.int32)), off


def _finds(raw: bytes, part: bytes):
    at = raw.find(part)
    while at >= 0:
        yield at
        at = raw.find(part, at + 1)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, with what it has seen so far."""
    return Encoder(path)
