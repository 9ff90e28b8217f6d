"""Vector codes: parts of vectors as the numbers of codebook entries, nearest entries by memoised grid cells.

A part's components are cut into coarse cells.  For a cell a task finds once which entries can be nearest to some point of
its box: an entry whose least distance to the box is above another entry's greatest distance is dominated there and can
neither win nor tie.  The cell's hash names the entries that are left in the task's memo, and only those are evaluated, by
whole numbers, so that results are exact.  The memo is bounded: beyond `MEMO_CELLS` cells it is emptied and filled again.

Codebooks are fitted by rounds of assigning all parts and replacing every entry by the floor of its parts' mean; the tasks
send sums by entry, at most parts times entries rows each, and a codebook is as large as `entries` vectors, whatever the
input.

Rows whose vector is null, or holds a null or non-finite component, go.  Vectors that can't be cut (another length than
that of most vectors that `parts` divides, no length at all) or that hold a component beyond `LARGEST` in size stay, without code
and error, and don't count in codebooks.  Repeated rows count each time; vectors of one id are ordered by their components.
Null ids come last.  Other columns than id, vector and label are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs
from .textops import U64, mix64

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components up to this size keep squared distances within whole numbers of 64 bits.
LARGEST = float(1 << 15)
#: Width of a coarse cell as a power of two, and cells that a task remembers for each part.
CELL_BITS, MEMO_CELLS = 5, 1 << 14


def usable(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """The rows with a vector of finite components, and `fits`: whether it can be cut and coded."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select("vec_id", x.cast("array<double>").alias("embedding"), "label").filter(x.isNotNull() & finite)
    size = F.size("embedding")
    sizes = kept.filter((size > 0) & (size % parts == 0)).groupBy(size.alias("size")).count()
    most = sizes.orderBy(F.desc("count"), "size").first()  # one row
    fits = (size == (most["size"] if most else 0)) & F.forall("embedding", lambda v: F.abs(v) <= LARGEST) & (size > 0)
    return kept.withColumn("fits", fits)


def _integers(column: pa.Array, scale: int) -> np.ndarray:
    values = np.asarray(column.flatten(), np.float64)
    return np.floor(values * scale).astype(np.int64).reshape(len(column), -1)


class Cells:
    """The nearest entries of one part position's codebook."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS, most: int = MEMO_CELLS):
        self.entries, self.bits, self.most = entries, bits, most
        self.memo: dict[int, tuple[bytes, np.ndarray]] = {}

    def left_over(self, corner: np.ndarray) -> list[np.ndarray]:
        """For each cell, by its least corner, the entries not dominated across its box."""
        low, high = corner[:, None, :], corner[:, None, :] + ((1 << self.bits) - 1)
        below, above = low - self.entries, self.entries - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
        near = least <= most.min(1)[:, None]
        return [np.flatnonzero(x) for x in near]

    def __call__(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the first of equally near ones, and its squared distance."""
        cell = part >> self.bits
        name = np.zeros(len(part), U64)
        with np.errstate(over="ignore"):
            for column in cell.T:
                name = mix64(name * U64(0x9E3779B97F4A7C15) + column.astype(U64))
        names, first, inverse = np.unique(name, return_index=True, return_inverse=True)
        own = (cell == cell[first][inverse]).all(1)  # a row whose cell only shares the hash is held against all entries
        kinds = [self.memo.get(k) for k in names.tolist()]
        keys = [cell[i].tobytes() for i in first.tolist()]
        missing = [i for i, (k, b) in enumerate(zip(kinds, keys, strict=True)) if k is None or k[0] != b]
        if missing:
            if len(self.memo) + len(missing) > self.most:
                self.memo.clear()
            for at in range(0, len(missing), 1024):
                some = missing[at : at + 1024]
                for i, left in zip(some, self.left_over(cell[first[some]] << self.bits), strict=True):
                    kinds[i] = (keys[i], left)
                    if len(self.memo) < self.most:
                        self.memo[int(names[i])] = kinds[i]
        lists = [k[1] for k in kinds] + [np.arange(len(self.entries))]
        kind = np.where(own, inverse, len(lists) - 1)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate(lists)
        code, error = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        step = max(1, (1 << 20) // max(1, int(sizes.max())))
        for at in range(0, len(part), step):
            k = kind[at : at + step]
            n = sizes[k]
            begin = np.cumsum(n) - n
            entry = flat[np.arange(n.sum()) + np.repeat(starts[k] - begin, n)]
            distance = ((self.entries[entry] - np.repeat(part[at : at + step], n, axis=0)) ** 2).sum(1)
            best = np.minimum.reduceat(distance, begin)
            where = np.flatnonzero(distance == np.repeat(best, n))
            code[at : at + step] = entry[where[np.searchsorted(where, begin)]]  # entries ascend
            error[at : at + step] = best
        return code, error


def _cells(codebooks: np.ndarray) -> list[Cells]:
    return [Cells(x) for x in codebooks]


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    return x.reshape(len(x), parts, -1)


def _sums(codebooks: np.ndarray, scale: int):
    """Counts and sums of the parts of every entry, for a task's rows."""

    def run(batches):
        cells = _cells(codebooks)
        n = np.zeros(codebooks.shape[:2], np.int64)
        sums = np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _cut(_integers(batch.column("embedding"), scale), len(codebooks))
            for p, near in enumerate(cells):
                code, _ = near(x[:, p])
                n[p] += np.bincount(code, minlength=n.shape[1])
                np.add.at(sums[p], code, x[:, p])
        p, e = np.nonzero(n)
        values = jobs.lists(np.full(len(p), codebooks.shape[2]), pa.array(sums[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), values], ["part", "entry", "n", "sums"])

    return run


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts, entries, components) of whole numbers; rows: vec_id, embedding, all of them fit to be cut.

    Entries start as the parts of the `entries` smallest ids; what returns to the driver is as large as a codebook.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.floor(np.array([r[0] for r in first]) * scale).astype(np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        found = rows.select("embedding").mapInArrow(jobs.tidy(_sums(books, scale)), "part int, entry int, n long, sums array<long>")
        totals = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "s")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        for r in totals.collect():  # a row for each number of the codebooks at most
            books[r["part"], r["entry"], r["place"]] = r["s"] // r["n"]
    return books


def _encode(codebooks: np.ndarray, scale: int):
    def run(batches):
        cells = _cells(codebooks)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fits = np.asarray(batch.column("fits").fill_null(False))
            code, error = np.zeros((n, len(codebooks)), np.uint8), np.zeros(n, np.int64)
            if fits.any():
                x = _cut(_integers(batch.filter(batch.column("fits")).column("embedding"), scale), len(codebooks))
                for p, near in enumerate(cells):
                    found, distance = near(x[:, p])
                    code[fits, p] = found
                    error[fits] += distance
            texts = pa.array([c.tobytes().hex() if ok else None for c, ok in zip(code, fits.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), texts, pa.array(error, mask=~fits), batch.column("label")], ["vec_id", "code", "error", "label"])

    return run


def digest(codebooks: np.ndarray) -> str:
    """Lowercase hex sha256 of all components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label) of usable(): two hex digits a part, and the squared distances to the entries, summed."""
    label, key = rows.schema["label"].dataType.simpleString(), rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "embedding", "label", "fits").mapInArrow(jobs.tidy(_encode(codebooks, scale)), f"vec_id {key}, code string, error long, label {label}")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of (vec_id, embedding, label).

    label_error: the errors of a label's vectors summed, nulls together; null where the label has no coded vector, or the
    sum is too large for a long.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    rows = usable(vectors, parts)
    books = fit_codebooks(rows.filter("fits"), parts, entries, rounds, scale)
    coded = jobs.stored(encode(rows, books, scale), "vector-codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_cast(sum(cast(error as decimal(20, 0))) as long)").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
