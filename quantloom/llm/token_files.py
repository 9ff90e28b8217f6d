"""Token ids of documents as ORC files.

Files hold documents in ascending doc_id order: one range of ids a partition, sorted inside.  Ids are plain integers,
which ORC keeps run-length encoded; stripes are small enough to be read by tasks of their own, row indexes let a reader
skip row groups, and Bloom filters on doc_id let point look-ups skip stripes.  `part` and `row` give a document's place,
so that nothing depends on file names.

A null text is empty: its document is the end id alone.  Documents without a doc_id come first; rows of one doc_id are
ordered by their texts' hash.  Extra columns are ignored.  An empty table writes files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jobs
from .tokens import encoder

END_ID = 0
STRIPE_BYTES, ROWS_AN_INDEX = 8 << 20, 1000
FILE = "doc_id long, row long, n_tokens long, ids array<int>, part int"


def _encode(path: str, end_id: int):
    def run(batches):
        seen = 0
        for batch in jobs.slices(batches, most=8 << 20):
            ids, off = encoder(path).ids(batch.column("text"))
            n = batch.num_rows
            with_end = np.full(len(ids) + n, end_id, np.int32)
            with_end[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(off))] = ids
            sizes = np.diff(off) + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.arange(seen, seen + n)), pa.array(sizes), jobs.lists(sizes, pa.array(with_end))], ["doc_id", "row", "n_tokens", "ids"])
            seen += n

    return run


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode every text, append `end_id`, and write the ORC files at `path`."""
    n = jobs.partitions(docs.sparkSession)
    ranged = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    coded = ranged.mapInArrow(jobs.tidy(_encode(tokenizer, end_id)), "doc_id long, row long, n_tokens long, ids array<int>").withColumn("part", F.spark_partition_id())
    writer = coded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
    writer.option("orc.row.index.stride", ROWS_AN_INDEX).option("orc.stripe.size", STRIPE_BYTES).option("compression", "zstd").orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with `doc_ids` the filter reaches the stripes' statistics and Bloom filters."""
    df = spark.read.schema(FILE).orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        flat = np.asarray(ids.flatten()).astype("<u4", copy=False)
        off = np.append(0, np.cumsum(np.asarray(ids.value_lengths()).astype(np.int64)))
        view = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("row"), batch.column("doc_id"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["part", "row", "doc_id", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, read from the files.

    Starts come from sums by part, whose number is that of the partitions, and running sums inside a part.
    """
    files = read_token_files(spark, path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("row")
    rows = files.mapInArrow(jobs.tidy(_checksums), "part int, row long, doc_id long, n_tokens long, ids_crc32 long")
    rows = rows.withColumn("start", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return rows.join(before, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
