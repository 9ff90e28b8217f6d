"""Byte-level BPE encoding and decoding.

Encoding: tasks split their documents into pieces and number the distinct ones of each block of documents; the distinct
pieces meet by hash, and a fold over each one's bytes, in Spark's higher-order functions, merges the adjacent pair of
lowest rank until none has a rank.  The rank map is a literal: an array of small maps, picked by checksum, as a look-up
in one large map would scan it.  The ids go back to the blocks, where documents are put together from their pieces.
Decoding takes the binary piece of each id from the literal piece table and concatenates.

Documents are never exploded into a row a piece.  The blocks are formed twice, once for the pieces and once for the
documents, from the same input: an input that is more than a scan is stored first.  A block carries a fingerprint of its
pieces, so that files that change between the two are an error, not a wrong result.

A null text is empty and has no ids.  Repeated rows are each encoded.  Rows without a doc_id are encoded too.  Extra
columns are ignored.  The fold copies a piece's parts for each merge; a piece of more than `LONG` bytes, for which that
would take its square, is merged with a heap in the task that sends the ids back.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import jobs
from .pretokens import Pretokens
from .textops import U64, hash_spans, mix64

#: Distinct pieces and bytes of text at which a block ends.
BLOCK_PIECES, BLOCK_BYTES = 500_000, 64 << 20
#: Bytes of text split at once: a piece takes many bytes of arrays.
SLICE = 1 << 20
#: Bytes of the longest piece that the fold merges.
LONG = 2048
_BUCKETS = 1 << 14


@lru_cache(4)
def rank_table(path: str) -> list[bytes]:
    """The piece of each rank of a tiktoken file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    table = [b""] * (1 + max(int(r) for _, r in pairs))
    for piece, r in pairs:
        table[int(r)] = base64.b64decode(piece)
    return table


def _rank_literal(table: list[bytes]) -> Column:
    """array<map<string, int>>: ranks of pieces, written with one character a byte, by the low bits of their checksum."""
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for r, piece in enumerate(table):
        if piece:
            s = piece.decode("latin-1")
            buckets[zlib.crc32(s.encode()) & (_BUCKETS - 1)][s] = r
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def merged(word: Column, table: list[bytes]) -> Column:
    """The ids of one piece of text (binary): ranked merges folded over its bytes."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return let(_rank_literal(table), lambda ranks: _fold(word, ranks, let))  # bound once: the plan holds one copy


def _fold(word: Column, ranks: Column, let) -> Column:
    rank = lambda s: F.try_element_at(F.get(ranks, F.crc32(s).bitwiseAND(_BUCKETS - 1).cast("int")), s)
    none = F.array().cast("array<int>")

    def merge(parts: Column, pairs: Column, k: Column) -> Column:
        """Join parts k and k + 1 (from 1), and rank the two pairs that changes."""
        n = F.size(parts)

        def with_joined(joined: Column) -> Column:
            before, after = F.get(parts, k - 2), F.get(parts, k + 1)
            left = F.when(k > 1, F.array(rank(F.concat(before, joined)))).otherwise(none)
            right = F.when(k + 1 < n, F.array(rank(F.concat(joined, after)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(parts, 1, k - 1), F.array(joined), F.slice(parts, k + 2, n)).alias("parts"),
                F.concat(F.slice(pairs, 1, F.greatest(k - 2, F.lit(0))), left, right, F.slice(pairs, k + 2, n)).alias("pairs"),
            )

        return let(F.concat(F.get(parts, k - 1), F.get(parts, k)), with_joined)

    def step(state: Column, _: Column) -> Column:
        k = F.array_position(state["pairs"], F.array_min(state["pairs"])).cast("int")
        return F.when(F.array_min(state["pairs"]).isNull(), state).otherwise(let(k, lambda at: merge(state["parts"], state["pairs"], at)))

    def fold(chars: Column) -> Column:
        n = F.size(chars)
        pairs = F.zip_with(F.slice(chars, 1, n - 1), F.slice(chars, 2, n), lambda a, b: rank(F.concat(a, b)))
        start = F.struct(chars.alias("parts"), pairs.alias("pairs"))
        rounds = F.sequence(F.lit(1), n - 1)
        return F.aggregate(rounds, start, step, lambda state: F.transform(state["parts"], rank))

    text = F.decode(word, "ISO-8859-1")
    return let(text, lambda s: let(rank(s), lambda whole: F.when(whole.isNotNull(), F.array(whole)).when(F.length(s) < 2, none).otherwise(fold(F.split(s, "")))))


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long piece: its parts are a linked list, the ranked pairs a heap."""
    end, after, before = list(range(1, len(word) + 1)), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []  # rank, first byte, last byte of a pair

    def push(i: int) -> None:
        if i >= 0 and after[i] < len(word):
            stop = end[after[i]]
            rank = ranks.get(word[i:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, i, stop))

    for i in range(len(word) - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if end[i] < 0 or after[i] >= len(word) or end[after[i]] != stop:
            continue  # one of the two has been merged since
        j = after[i]
        end[i], end[j], after[i] = stop, -1, after[j]
        if after[i] < len(word):
            before[after[i]] = i
        push(i)
        push(before[i])
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class _Blocks:
    """Numbers the distinct pieces of a task's documents, block by block."""

    def __init__(self):
        self._new()

    def _new(self):
        self.keys, self.codes, self.bytes = np.zeros(0, U64), np.zeros(0, np.int64), 0
        self.docs, self.words, self.sizes, self.hashes = [], [], [], []

    def add(self, p: Pretokens, keep_words: bool):
        first, codes = p.distinct()
        keys = p.hashes[first]
        i = np.searchsorted(self.keys, keys)
        i[i == len(self.keys)] = 0
        new = self.keys[i] != keys if len(self.keys) else np.ones(len(keys), bool)
        fresh, count = keys[new], len(self.keys)
        all_keys = np.concatenate([self.keys, fresh])
        all_codes = np.concatenate([self.codes, count + np.arange(len(fresh))])
        order = np.argsort(all_keys)
        self.keys, self.codes = all_keys[order], all_codes[order]
        self.hashes.append(fresh)
        if keep_words:
            at = first[new]
            sizes = (p.ends - p.starts)[at]
            index = np.repeat(p.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            self.words.append(p.raw[index]), self.sizes.append(sizes)
        self.bytes += len(p.raw)
        return self.codes[np.searchsorted(self.keys, keys)][codes]

    def full(self) -> bool:
        return len(self.keys) >= BLOCK_PIECES or self.bytes >= BLOCK_BYTES

    def end(self) -> int:
        """The block's name: a fingerprint of its pieces in their order, which is all that its numbers depend on."""
        h = np.concatenate(self.hashes) if self.hashes else np.zeros(0, U64)
        with np.errstate(over="ignore"):
            return int(mix64(h + mix64(np.arange(len(h), dtype=U64))).sum(dtype=U64).view(np.int64))


def _planes(codes: np.ndarray) -> bytes:
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _words(n: int):
    """A block's distinct pieces, dealt by hash: (bucket, blob of block, numbers, sizes and bytes)."""

    def emit(b: _Blocks):
        block = b.end()
        hashes, sizes, raw = np.concatenate(b.hashes), np.concatenate(b.sizes), np.concatenate(b.words)
        starts = np.cumsum(sizes) - sizes
        bucket = ((hashes >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n + 1))
        press, out = zstandard.ZstdCompressor(1), []
        for k in np.flatnonzero(np.diff(cuts)):
            w = order[cuts[k] : cuts[k + 1]]
            index = np.repeat(starts[w] - (np.cumsum(sizes[w]) - sizes[w]), sizes[w]) + np.arange(sizes[w].sum())
            out.append((int(k), np.array([len(w)], "<u4").tobytes() + np.array([block], "<i8").tobytes() + press.compress(w.astype("<u4").tobytes() + sizes[w].astype("<u4").tobytes() + raw[index].tobytes())))
        return jobs.blob_batch(out)

    def run(batches):
        b = _Blocks()
        for batch in jobs.slices(batches, most=SLICE):
            p = Pretokens(batch.column("text"))
            if len(p.starts):
                b.add(p, True)
            if b.full():
                yield emit(b)
                b._new()
        if len(b.keys):
            yield emit(b)

    return run


def _distinct(batches):
    """Each distinct piece of the partition once, with the blocks and numbers it has there."""
    blocks, numbers, sizes, raws = [], [], [], []
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            n, block = int(np.frombuffer(blob, "<u4", 1)[0]), np.frombuffer(blob, "<i8", 1, 4)[0]
            raw = opener.decompress(blob[12:])
            numbers.append(np.frombuffer(raw, "<u4", n))
            sizes.append(np.frombuffer(raw, "<u4", n, 4 * n))
            raws.append(np.frombuffer(raw, np.uint8, offset=8 * n))
            blocks.append(np.full(n, block))
    if not blocks:
        return
    block, number, size, raw = np.concatenate(blocks), np.concatenate(numbers), np.concatenate(sizes).astype(np.int64), np.concatenate(raws)
    ends = np.cumsum(size)
    hashes = hash_spans(raw, ends - size, ends)
    order = np.argsort(hashes, kind="stable")
    cut = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
    stop = np.append(cut[1:], len(order))
    refs = np.concatenate([block[order, None].view(np.uint8).reshape(-1, 8), number[order].astype("<u4").view(np.uint8).reshape(-1, 4)], 1)
    for a in range(0, len(cut), 4096):
        part = range(a, min(a + 4096, len(cut)))
        words, where = [], []
        for k in part:
            i = order[cut[k]]
            word = raw[ends[i] - size[i] : ends[i]].tobytes()
            for at in range(cut[k], stop[k], 1 << 16):  # a row's references are bounded
                words.append(word), where.append(refs[at : min(stop[k], at + (1 << 16))].tobytes())
        yield pa.RecordBatch.from_arrays([jobs.binaries(words), jobs.binaries(where)], ["word", "refs"])


_TO_BLOCK = "block long, kind int, blob binary"


def _with_long(batch: pa.RecordBatch, table) -> pa.Array:
    """The ids of a batch's pieces, with those of long pieces, which the fold left out."""
    ids, long = batch.column("ids"), batch.column("long")
    if long.null_count == len(long):
        return ids
    ranks = {piece: r for r, piece in enumerate(table.value) if piece}
    lists = [i if w is None else merged_long(w, ranks) for i, w in zip(ids.to_pylist(), long.to_pylist(), strict=True)]
    return pa.array(lists, ids.type)


def _to_blocks(table):
    """Ids of pieces on their way back: one blob for each block of numbers, counts and ids."""

    def run(batches):
        yield from _block_ids(batches, table)

    return run


def _block_ids(batches, table):
    nums, blocks, counts, flats = [], [], [], []
    for batch in batches:
        ids = _with_long(batch, table)
        size = np.asarray(ids.value_lengths()).astype(np.int64)
        flat = np.asarray(ids.flatten())
        refs = batch.column("refs").to_pylist()
        k = np.array([len(r) // 12 for r in refs])
        both = np.frombuffer(b"".join(refs), np.uint8).reshape(-1, 12)
        starts = np.repeat(np.cumsum(size) - size, k)
        size = np.repeat(size, k)
        blocks.append(np.ascontiguousarray(both[:, :8]).view("<i8").ravel()), nums.append(np.ascontiguousarray(both[:, 8:]).view("<u4").ravel())
        counts.append(size), flats.append(flat[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())])
    if not blocks:
        return
    block, num, count, flat = (np.concatenate(x) for x in (blocks, nums, counts, flats))
    order = np.argsort(block, kind="stable")
    cut = np.flatnonzero(np.append(True, block[order][1:] != block[order][:-1]))
    starts, press = np.cumsum(count) - count, zstandard.ZstdCompressor(1)
    names, blobs = [], []
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist(), strict=True):
        w = order[a:b]
        c = count[w]
        ids = flat[np.repeat(starts[w] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        names.append(block[w[0]])
        blobs.append(np.array([len(w)], "<u4").tobytes() + press.compress(num[w].tobytes() + c.astype("<u4").tobytes() + _planes(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(np.array(names)), pa.array(np.zeros(len(names), np.int32)), jobs.binaries(blobs)], ["block", "kind", "blob"])


def _documents(batches):
    """The documents as numbers of their block's pieces, a blob for each slice."""

    def emit(b: _Blocks):
        block = b.end()
        k = len(b.docs)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array(np.ones(k, np.int32)), jobs.binaries(b.docs)], ["block", "kind", "blob"])

    b, press = _Blocks(), zstandard.ZstdCompressor(3)
    for batch in jobs.slices(batches, most=SLICE):
        p = Pretokens(batch.column("text"))
        codes = b.add(p, False) if len(p.starts) else np.zeros(0, np.int64)
        ids = batch.column("doc_id")
        head = np.asarray(ids.fill_null(0)).astype("<i8").tobytes() + np.asarray(ids.is_valid()).astype("u1").tobytes() + p.counts.astype("<u4").tobytes()
        b.docs.append(np.array([batch.num_rows], "<u4").tobytes() + press.compress(head + _planes(codes)))
        if b.full():
            yield emit(b)
            b._new()
    if b.docs:
        yield emit(b)


def _assembled(table, digests: bool):
    """Documents of a block from its pieces' ids; a block's pieces come before its documents."""

    def run(batches):
        opener, current, parts = zstandard.ZstdDecompressor(), None, []
        at = count = flat = None
        pieces = None
        for batch in batches:
            for block, kind, blob in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if block != current:
                    current, parts, at = block, [], None
                n = int(np.frombuffer(blob, "<u4", 1)[0])
                raw = np.frombuffer(opener.decompress(blob[4:]), np.uint8)
                if kind == 0:
                    parts.append((raw[: 4 * n].view("<u4"), raw[4 * n : 8 * n].view("<u4").astype(np.int64), _from_planes(raw[8 * n :]).astype(np.int32)))
                    continue
                if at is None:
                    num = np.concatenate([x[0] for x in parts]) if parts else np.zeros(0, np.int64)
                    sizes = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, np.int64)
                    flat = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, np.int32)
                    most = int(num.max()) + 1 if len(num) else 0
                    at, count = np.full(most, -1, np.int64), np.zeros(most, np.int64)
                    at[num], count[num] = np.cumsum(sizes) - sizes, sizes
                    parts = []
                ids = raw[: 8 * n].view("<i8")
                valid = raw[8 * n : 9 * n].astype(bool)
                per_doc = np.frombuffer(raw[9 * n : 13 * n].tobytes(), "<u4").astype(np.int64)
                codes = _from_planes(raw[13 * n :])
                if len(codes) and (int(codes.max()) >= len(at) or (at[codes] < 0).any()):
                    raise ValueError("the documents changed between two reads: store them first")
                c = count[codes] if len(codes) else np.zeros(0, np.int64)
                tokens = flat[np.repeat(at[codes] - (np.cumsum(c) - c), c) + np.arange(c.sum())] if len(codes) else np.zeros(0, np.int32)
                off = np.append(0, np.cumsum(c))[np.append(0, np.cumsum(per_doc))]
                doc_id = pa.array(ids.copy(), mask=~valid)
                if not digests:
                    yield pa.RecordBatch.from_arrays([doc_id, jobs.lists(np.diff(off), pa.array(tokens))], ["doc_id", "ids"])
                    continue
                pieces = pieces if pieces is not None else jobs.binaries(table.value).cast(pa.large_binary())
                view = memoryview(np.ascontiguousarray(tokens.astype("<u4"))).cast("B")
                text = pieces.take(pa.array(tokens))
                _, text_off, data = text.buffers()
                text_off = np.frombuffer(text_off, np.int64)[text.offset : text.offset + len(text) + 1]
                text_view, ends = memoryview(data if data is not None else b"").cast("B"), text_off[off].tolist()
                sha = lambda x: hashlib.sha256(x).hexdigest().encode()
                spans = off.tolist()
                cols = [jobs.binaries([sha(view[4 * a : 4 * b]) for a, b in zip(spans[:-1], spans[1:], strict=True)], pa.string()), jobs.binaries([sha(text_view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())]
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(np.diff(off)), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(docs: DataFrame, path: str, digests: bool, schema: str) -> DataFrame:
    spark = docs.sparkSession
    n, table = jobs.partitions(spark), rank_table(path)
    docs = docs.select("doc_id", "text")
    if not jobs.is_scan(docs):
        docs = jobs.stored(docs, "documents")
    shared = spark.sparkContext.broadcast(table)
    # both reads take the same columns, so that their batches are cut alike
    words = jobs.exchange(docs, _words(n), n).mapInArrow(jobs.tidy(_distinct), "word binary, refs binary")
    short = F.octet_length("word") <= LONG
    ids = F.when(short, merged(F.when(short, F.col("word")).otherwise(F.lit(b"")), table)).otherwise(F.array().cast("array<int>"))
    coded = words.select("refs", ids.alias("ids"), F.when(~short, F.col("word")).alias("long"))
    back = coded.mapInArrow(jobs.tidy(_to_blocks(shared)), _TO_BLOCK).unionByName(docs.mapInArrow(jobs.tidy(_documents), _TO_BLOCK))
    return back.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(jobs.tidy(_assembled(shared, digests)), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text, by the ranks of a tiktoken file, without special tokens."""
    return _encoded(docs, path, False, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """The rows with `decoded` (binary): the pieces of `ids`, concatenated; a null list gives null."""
    table = ids.sparkSession.sparkContext.broadcast(rank_table(path))

    def run(batches):
        pieces = jobs.binaries(table.value).cast(pa.large_binary())
        for batch in batches:
            lists = batch.column("ids")
            text = pieces.take(lists.flatten())
            _, off, data = text.buffers()
            off, raw = np.frombuffer(off, np.int64), memoryview(data if data is not None else b"").cast("B")
            ends = off[np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)))].tolist()
            out = [raw[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return ids.mapInArrow(jobs.tidy(run), StructType([*ids.schema, StructField("decoded", BinaryType())]))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes they decode to."""
    return _encoded(docs, path, True, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
