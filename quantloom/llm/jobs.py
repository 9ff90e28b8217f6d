"""What the operators share as Spark jobs: reading tables, shared scratch folders, packed exchange between tasks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text and rows that a task splits at once.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1 << 15
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir; set here only where it is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows to the shared folder and read them back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


_SCAN = {"Project", "Filter", "LogicalRelation", "Relation", "LocalRelation", "SubqueryAlias"}


def is_scan(df: DataFrame) -> bool:
    """True if df only reads, selects and filters, so that two runs deal its rows to tasks alike."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _SCAN and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName() in _SCAN and plan.children().size() == 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `most` bytes of text (one longer text is a run of its own), at most SLICE_ROWS."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            end = min(end, at + SLICE_ROWS, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def tidy(run: Callable) -> Callable:
    """A task's function that gives freed memory back when it ends: workers stay, idle, for the next task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped


def packed(bucket: np.ndarray, n_buckets: int, arrays: Sequence[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Rows of parallel arrays as one blob for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    arrays = [a[order] for a in arrays]
    for b in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[b], cuts[b + 1])
        yield int(b), b"".join(np.ascontiguousarray(a[part]).tobytes() for a in arrays)


def unpacked(blobs: list[bytes], dtypes: Sequence) -> list[np.ndarray]:
    """The arrays of `packed` again, over all blobs."""
    dtypes = [np.dtype(d) for d in dtypes]
    row = sum(d.itemsize for d in dtypes)
    out: list[list[np.ndarray]] = [[] for _ in dtypes]
    for blob in blobs:
        n, at = len(blob) // row, 0
        for k, d in enumerate(dtypes):
            out[k].append(np.frombuffer(blob, d, n, at))
            at += n * d.itemsize
    return [np.concatenate(x) if x else np.zeros(0, d) for x, d in zip(out, dtypes, strict=True)]


def exchange(df: DataFrame, pack: Callable, n: int) -> DataFrame:
    """Rows (bucket, blob) that `pack` makes of df's batches, with the blobs of a bucket in one partition."""
    blobs = df.mapInArrow(tidy(pack), "bucket int, blob binary")
    return blobs.repartitionById(n, F.col("bucket"))


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array([b for b, _ in rows], np.int32)), binaries([x for _, x in rows])], ["bucket", "blob"])


def binaries(values: Sequence[bytes], kind: pa.DataType | None = None) -> pa.Array:
    """Bytes as an Arrow array of binary or string, none of them null.

    pa.array of a list loads pandas into the worker, which takes as much memory as all else that a worker loads.
    """
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, values), np.int64, len(values)), out=offsets[1:])
    return pa.Array.from_buffers(kind or pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(values))])


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application: they need not have it installed.

    Batches between Spark and its Python tasks are held to `BATCH_BYTES`, as both sides keep some of them.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
