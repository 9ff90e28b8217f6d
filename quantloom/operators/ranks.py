"""Exact expanding ranks: how many earlier values of a series are at most, or below, each value.

For a row the rows to count lie before it in time and in value.  Rows are sorted by time and cut into chunks of `block`
rows, and sorted by value (ties by time) and cut into buckets of as many.  What a row counts falls apart into three:

    rows of its own bucket that are earlier            counted in the bucket's task
    rows of its own chunk, in lower buckets            counted in the chunk's task
    rows of earlier chunks, in lower buckets           from a table of chunks by buckets, summed along both

So a task holds one chunk or one bucket, however long a series or frequent a value is, and one series is worked on by many
tasks.  The table has a row for each chunk and bucket of a key: (rows / block) squared.  Both sorts are Spark's, by range.

Rows without a value have no rank and aren't counted.  The order must be total within a key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

BLOCK = 1 << 15


def earlier_smaller(rank: np.ndarray) -> np.ndarray:
    """For each item the number of items before it that are smaller; the items are 0 to n - 1 in some order.

    Blocks are merged bottom up: an item in a right half counts the smaller items of the left half beside it.
    """
    n = len(rank)
    out, place, width = np.zeros(n, np.int64), np.arange(n), 1
    by_rank = np.empty(n, np.int64)
    by_rank[rank] = place  # places in order of rank
    while width < n:
        block = by_rank // (2 * width)
        order = by_rank[np.argsort(block, kind="stable")]  # by block, within it by rank
        left = (order // width) % 2 == 0
        seen = np.cumsum(left)
        begin = (order // (2 * width)) * (2 * width)  # a block begins at this place, and all blocks before it are whole
        out[order] += np.where(left, 0, seen - np.append(0, seen)[begin])
        width *= 2
    return out


def _starts(batch: pa.RecordBatch, names: Sequence[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Which rows differ from the row before them in one of the columns; `last` is the row before the first."""
    out = np.zeros(batch.num_rows, bool)
    for name in names:
        col = batch.column(name)
        before = pa.concat_arrays([last.column(name) if last is not None else col.slice(0, 1), col.slice(0, len(col) - 1)])
        differ = pc.coalesce(pc.not_equal(col, before), pc.xor(pc.is_null(col), pc.is_null(before)))
        out |= np.asarray(differ)
    if last is None and len(out):
        out[0] = True
    return out


def _pieces(batches: Iterator[pa.RecordBatch], keys: Sequence[str], block: int) -> Iterator[tuple[int, pa.Table]]:
    """A task's sorted rows in pieces of one key and at most `block` rows, with ascending numbers over all tasks."""
    number, held, last = TaskContext.get().partitionId() << 32, [], None
    count = 0

    def whole():
        return pa.Table.from_batches(held)

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.append(np.flatnonzero(_starts(batch, keys, last)), batch.num_rows)
        last = batch.slice(batch.num_rows - 1, 1)
        at = 0
        for end in starts.tolist():  # runs of one key; the first may go on from the batch before
            if count and end == at and at < batch.num_rows:
                yield number, whole()
                number, held, count = number + 1, [], 0
            while at < end:
                take = min(end - at, block - count)
                held.append(batch.slice(at, take))
                at, count = at + take, count + take
                if count == block or (at == end and end < batch.num_rows):
                    yield number, whole()
                    number, held, count = number + 1, [], 0
    if count:
        yield number, whole()


def _with(table: pa.Table, **columns: np.ndarray) -> pa.RecordBatch:
    for name, values in columns.items():
        table = table.append_column(name, pa.array(values))
    return table.combine_chunks().to_batches()[0]


def _chunked(keys: Sequence[str], block: int):
    def run(batches):
        for number, rows in _pieces(batches, keys, block):
            n = rows.num_rows
            yield _with(rows, chunk_=np.full(n, number, np.int64), at_=np.arange(n, dtype=np.int32))

    return run


def _bucketed(keys: Sequence[str], block: int, itself: int):
    def run(batches):
        for number, rows in _pieces(batches, keys, block):
            chunk, at = (rows.column(c).to_numpy() for c in ("chunk_", "at_"))
            rank = np.empty(len(at), np.int64)
            rank[np.lexsort((at, chunk))] = np.arange(len(at))
            yield _with(rows.select([*keys, "chunk_", "at_"]), bucket_=np.full(len(at), number, np.int64), inside_=earlier_smaller(rank) + itself)

    return run


def _within(batches):
    """Chunk by chunk, in time: rows before a row that are in lower buckets."""
    for _, rows in _pieces(batches, ["chunk_"], 1 << 62):
        bucket, at = rows.column("bucket_").to_numpy(), rows.column("at_").to_numpy()
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((-at.astype(np.int64), bucket))] = np.arange(len(at))  # of one bucket, the later row comes first
        yield _with(rows, within_=earlier_smaller(rank))


def _counted(rows: DataFrame, keys: list[str], value: str, block: int, name: str, strict: bool) -> DataFrame:
    """(chunk_, at_, name) of chunked rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    time = [F.col("chunk_").desc(), F.col("at_").desc()] if strict else [F.col("chunk_").asc(), F.col("at_").asc()]
    by = [*(F.col(k) for k in keys), F.col(value), *time]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    named = "".join(f"`{k}` {types[k]}, " for k in keys)
    sorted_ = rows.select(*keys, value, "chunk_", "at_").repartitionByRange(n, *by).sortWithinPartitions(*by)
    buckets = stored(sorted_.mapInArrow(_bucketed(keys, block, 0 if strict else 1), f"{named}chunk_ long, at_ int, bucket_ long, inside_ long"), "buckets")
    cells = buckets.groupBy(*keys, "chunk_", "bucket_").agg(F.count("*").alias("n_"))
    sides = [cells.select(*(F.col(k).alias(f"{k}{side}") for k in keys), c).distinct() for side, c in (("_l", "chunk_"), ("_r", "bucket_"))]
    same = [F.col(f"{k}_l").eqNullSafe(F.col(f"{k}_r")) for k in keys]
    every = sides[0].join(sides[1], same).select("chunk_", "bucket_").join(cells.select("chunk_", "bucket_", "n_"), ["chunk_", "bucket_"], "left")
    earlier = F.coalesce(F.sum("n_").over(Window.partitionBy("bucket_").orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = F.coalesce(F.sum("earlier_").over(Window.partitionBy("chunk_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = every.withColumn("earlier_", earlier).withColumn("lower_", lower).filter("n_ is not null").select("chunk_", "bucket_", "lower_")
    chunks = buckets.select("chunk_", "at_", "bucket_", "inside_").repartition(n, "chunk_").sortWithinPartitions("chunk_", "at_")
    found = chunks.mapInArrow(_within, "chunk_ long, at_ int, bucket_ long, inside_ long, within_ long")
    return found.join(table, ["chunk_", "bucket_"]).select("chunk_", "at_", (F.col("inside_") + F.col("within_") + F.col("lower_")).alias(name))


def expanding_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, kinds: Sequence[str] = ("le",), block: int = BLOCK) -> DataFrame:
    """df with `n`, how many values there are up to and with each row, and of those `le`, how many don't exceed its own, and `lt`, how many are below it."""
    keys = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    given = df.filter(F.col(value).isNotNull())
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = stored(given.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_chunked(keys, block), f"{types}, chunk_ long, at_ int"), "chunks")
    sizes = rows.groupBy(*keys, "chunk_").agg(F.count("*").alias("size_"))
    before = F.coalesce(F.sum("size_").over(Window.partitionBy(*keys).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(sizes.select("chunk_", before.alias("before_")), "chunk_").withColumn("n", F.col("before_") + F.col("at_") + 1)
    for kind in kinds:
        out = out.join(_counted(rows, keys, value, block, kind, kind == "lt"), ["chunk_", "at_"])
    missing = df.filter(F.col(value).isNull()).withColumns({c: F.lit(None).cast("long") for c in ("n", *kinds)})
    return out.select(*df.columns, "n", *kinds).unionByName(missing)
