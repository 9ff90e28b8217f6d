"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A text is a sequence of symbols, one for each window of `width` words.  All documents' texts are the reference, in blocks:
a block holds the pieces of text whose windows have the same smallest hash of an `ANCHOR`-word gram, so that a window can
occur in one block only, and looking it up there is looking it up in every block.  A block's index gives for a symbol its
occurrence in the document of smallest doc_id.  A document's pieces are parsed greedily: a factor starts where a symbol
occurs in an earlier document, and follows that reference text as far as both agree; at its boundary the next symbol is
looked up again.  Pieces meet at block boundaries and are put together per document before words are removed, so a factor
of n symbols removes n + width - 1 words, wherever boundaries fall.  The cost is linear in the words; no pairs of
documents are formed, however many copies there are.

A passage that many documents share would fill one block.  Pieces that equal one of an earlier document in the same slice
of a task are factors at once, and don't travel: of a slice's copies one goes to the block.

Null and empty texts have no words.  Rows without a doc_id remove and lose nothing.  Repeated rows of one doc_id count
as one document, so they don't remove each other's words.  Extra columns are ignored.  Words are compared by 64-bit
hashes, windows by 40 bits of hash beside the 64 of their anchor, folded to 64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs
from .textops import SPACED, U64, Words, joined, long_window_hashes, mix64

#: Words of a window, and of the grams that name its block.
WIDTH, ANCHOR = 50, 16
_PIECE = ["<u8", "<i8", "<i8", "<u4", "u1"]  # anchor, doc_id, row key, first window, windows


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def _pieces(words: Words, ids: np.ndarray, keys: np.ndarray, valid: np.ndarray, width: int, anchor: int):
    """Pieces (anchor, doc_id, row key, first window, count) and the 40-bit hashes of their windows, in order."""
    n = len(words.hashes) - width + 1
    if n <= 0:
        return None
    rows = words.row_of()
    ok = (rows[:n] == rows[width - 1 :]) & valid[rows[:n]]
    at = np.flatnonzero(ok)
    if not len(at):
        return None
    grams = long_window_hashes(words.hashes, anchor)
    name = _sliding_min(grams, width - anchor + 1)[at]
    hashes = long_window_hashes(words.hashes, width)[at]
    row = rows[at]
    first = np.ones(len(at), bool)
    first[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    # the same gram may be smallest for more windows than one byte counts only if it repeats: cut those
    count = np.diff(np.append(start, len(at)))
    if count.max() > 255:
        extra = np.concatenate([np.arange(s, s + c, 255) for s, c in zip(start[count > 255], count[count > 255], strict=True)])
        start = np.union1d(start, extra)
        count = np.diff(np.append(start, len(at)))
    pos = at[start] - words.rows[row[start]]
    low = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    with np.errstate(over="ignore"):
        place = np.arange(len(at)) - np.repeat(start, count)
        text = np.add.reduceat(mix64(hashes + place.astype(U64) * U64(0xD6E8FEB86659FD93)), start)
    return name[start], ids[row[start]], keys[row[start]], pos.astype("<u4"), count.astype("u1"), low, mix64(text + name[start])


def _repeats(text: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pieces equal one of a smaller doc_id among them, and that doc_id."""
    order = np.lexsort((doc, text))
    first = np.append(True, text[order][1:] != text[order][:-1])
    least = np.empty(len(doc), np.int64)
    least[order] = doc[order][first][np.cumsum(first) - 1]
    return doc > least, least


def _pack(n: int, width: int, anchor: int):
    def run(batches):
        for batch in jobs.slices(batches):
            words = Words(batch.column("text"), SPACED, False)
            ids = batch.column("doc_id")
            valid = np.asarray(ids.is_valid())
            got = _pieces(words, np.asarray(ids.fill_null(0)), np.asarray(batch.column("row_key")), valid, width, anchor)
            if got is None:
                continue
            name, doc, key, pos, count, low, text = got
            again, source = _repeats(text, doc)
            if again.any():
                yield _factor_batch(key[again], pos[again].astype(np.int64), count[again].astype(np.int64), source[again], n)
            bucket = np.where(again, n, mix64(name) % U64(n)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n + 1))
            ends = np.cumsum(count.astype(np.int64))
            out = []
            for b in np.flatnonzero(np.diff(cuts)):  # those that are factors already have no bucket
                p = order[cuts[b] : cuts[b + 1]]
                c = count[p].astype(np.int64)
                index = np.repeat(ends[p] - np.cumsum(c), c) + np.arange(c.sum())
                head = np.array([len(p)], "<u4").tobytes()
                out.append((int(b), head + b"".join(a[p].astype(t).tobytes() for a, t in zip((name, doc, key, pos, count), _PIECE, strict=True)) + low[index].tobytes()))
            yield _blob_rows(out)

    return run


def _read(blobs):
    """Pieces and window hashes of all blobs of a block."""
    cols = [[] for _ in _PIECE]
    lows = []
    for blob in blobs:
        n, at = int(np.frombuffer(blob, "<u4", 1)[0]), 4
        for k, t in enumerate(_PIECE):
            cols[k].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
        raw = np.frombuffer(blob, np.uint8, offset=at).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        lows.append(wide.view("<u8").ravel())
    return [np.concatenate(c) for c in cols], np.concatenate(lows)


_FACTORS = "row_key long, first array<int>, windows array<int>, source array<long>"
_PACKED = f"bucket int, blob binary, {_FACTORS}"
_PACKED_NAMES = ["bucket", "blob", "row_key", "first", "windows", "source"]


def _factor_batch(key: np.ndarray, first: np.ndarray, windows: np.ndarray, source: np.ndarray, buckets: int = 0) -> pa.RecordBatch:
    """Factors as a row for each row key: first words, counts of windows, and the documents they repeat; with buckets, as packed rows."""
    order = np.lexsort((first, key))
    k = key[order]
    cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    sizes = np.diff(np.append(cut, len(k)))
    lists = [jobs.lists(sizes, pa.array(x[order].astype(t))) for x, t in ((first, np.int32), (windows, np.int32), (source, np.int64))]
    head = [pa.array((k[cut] % buckets).astype(np.int32)), pa.nulls(len(cut), pa.binary())] if buckets else []
    return pa.RecordBatch.from_arrays([*head, pa.array(k[cut]), *lists], _PACKED_NAMES if buckets else _PACKED_NAMES[2:])


def _blob_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.array([b for b, _ in rows], np.int32)), jobs.binaries([x for _, x in rows]), pa.nulls(n, pa.int64()), pa.nulls(n, ints), pa.nulls(n, ints), pa.nulls(n, pa.list_(pa.int64()))], _PACKED_NAMES)


def _parsed(window: np.ndarray, piece: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of the pieces of a partition's blocks: first symbol, number of symbols, and place in the reference.

    window, piece, docs: a symbol's value, piece and document, piece by piece.  The index is the order of symbols by value,
    then document: its first of each value is the occurrence in the earliest document.
    """
    order = np.lexsort((docs, window))
    start = np.flatnonzero(np.append(True, window[order][1:] != window[order][:-1]))
    ref = np.empty(len(window), np.int64)
    ref[order] = np.repeat(order[start], np.diff(np.append(start, len(order))))
    del order
    found = docs > docs[ref]
    same = np.append(False, piece[1:] == piece[:-1])  # a symbol's piece goes on from the one before
    follows = same & np.append(False, found[:-1]) & found
    onward = follows & np.append(False, (ref[1:] == ref[:-1] + 1)) & same[ref]
    begin = np.flatnonzero(found & ~onward)
    if not len(begin):
        return begin, begin, begin
    stop = np.append(begin[1:], len(window))
    run = np.cumsum(found)  # all found symbols from one start to the next stand together
    first, at = begin.copy(), ref[begin]
    length = np.minimum(stop - begin, run[stop - 1] - run[begin] + 1)
    # a start that follows a factor directly: that factor goes on as far as its own reference text agrees
    owner = np.arange(len(begin))
    for k in np.flatnonzero(follows[begin]).tolist():
        before = owner[k - 1]
        a, r, n = first[k], at[before] + length[before], length[k]
        part = piece[r : r + n] == piece[at[before]]
        agree = part & (window[r : r + len(part)] == window[a : a + len(part)]) & (docs[r : r + len(part)] < docs[a])
        m = len(agree) if agree.all() else int(agree.argmin())
        length[before] += m
        if m == n:
            owner[k], length[k] = before, 0
        elif m:
            first[k], length[k], at[k] = a + m, n - m, ref[a + m]
    kept = length > 0
    return first[kept], length[kept], at[kept]


def _factors(batches):
    """The factors found before the exchange, and those of parsing the pieces of a partition's blocks."""
    blobs = []
    for batch in batches:
        blobs += batch.column("blob").drop_null().to_pylist()
        done = batch.filter(batch.column("row_key").is_valid())
        if done.num_rows:
            yield done.select(_PACKED_NAMES[2:])
    if not blobs:
        return
    (name, doc, key, pos, count), low = _read(blobs)
    del blobs
    piece = np.repeat(np.arange(len(name)), count)
    with np.errstate(over="ignore"):
        window = mix64(mix64(name)[piece] + low * U64(0x9E3779B97F4A7C15))
    docs = doc[piece]
    first, length, ref = _parsed(window, piece, docs)
    if not len(first):
        return
    head = np.cumsum(count.astype(np.int64)) - count
    p = piece[first]
    yield _factor_batch(key[p], pos[p].astype(np.int64) + (first - head[p]), length, docs[ref])


def duplicate_factors(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """Factors of the documents that earlier documents hold: row_key, first word of each, its count of windows, and the document.

    docs: doc_id, text, row_key.  A factor of n windows is a run of n + width - 1 words.
    """
    n = jobs.partitions(docs.sparkSession)
    pieces = docs.select("doc_id", "text", "row_key").mapInArrow(jobs.tidy(_pack(n, width, anchor)), _PACKED).repartitionById(n, F.col("bucket"))
    return pieces.mapInArrow(jobs.tidy(_factors), _FACTORS)


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _removed(batch: pa.RecordBatch, words: Words, width: int) -> np.ndarray:
    """True for each word that a factor covers."""
    firsts, counts = batch.column("first"), batch.column("windows")
    per_row = np.asarray(pc.fill_null(pc.list_value_length(firsts), 0))
    at = np.asarray(firsts.flatten()).astype(np.int64) + np.repeat(words.rows[:-1], per_row)
    end = at + np.asarray(counts.flatten()) + width - 1
    mark = np.zeros(len(words.hashes) + 1, np.int32)
    np.add.at(mark, at, 1)
    np.add.at(mark, end, -1)
    return np.cumsum(mark[:-1]) > 0


def _remove(width: int, texts: bool):
    def run(batches):
        for batch in jobs.slices(batches):
            words = Words(batch.column("text"), SPACED, False)
            gone = _removed(batch, words, width)
            raw, off = joined(words, ~gone)
            view = memoryview(raw)
            cut = np.maximum(off[1:] - 1, off[:-1])
            kept = [view[a:b] for a, b in zip(off[:-1].tolist(), cut.tolist(), strict=True)]
            n_gone = np.bincount(words.row_of()[gone], minlength=len(words.counts))
            cols = [batch.column("doc_id"), pa.array(words.counts), pa.array(n_gone), jobs.binaries([hashlib.sha256(x).hexdigest().encode() for x in kept], pa.string())]
            if texts:
                cols.append(jobs.binaries([bytes(x) for x in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts)

    return run


def substring_dedup(docs: DataFrame, width: int = WIDTH, texts: bool = True) -> DataFrame:
    """Remove the words covered by a `width`-word window that starts in a document of smaller doc_id, too.

    Returns doc_id, n_words, n_removed, kept_sha256, and with `texts` the kept words joined by one space (kept_text).
    """
    docs = docs.select("doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    factors = duplicate_factors(docs, width, min(ANCHOR, width)).groupBy("row_key").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("windows")).alias("windows"))
    found = docs.join(factors, "row_key", "left").select("doc_id", "text", "first", "windows")
    return found.mapInArrow(jobs.tidy(_remove(width, texts)), _OUT + ", kept_text string" * texts)
