"""Keyed tables that streams and batches merge into, published version by version.

A table has one row for each key, the last one by its order columns.  Keys are dealt to a fixed number of buckets.  A merge
writes new files for the buckets that its rows touch, next to the old ones, and then publishes a version: a small file that
says which folder holds each bucket, and up to which batch each source has been merged.  Readers follow the latest version,
so they see all of a batch or nothing of it; a merge that dies before it publishes leaves files that no version names.
A batch that a source hands over again, after a restart, changes nothing.

Equal orders are won by the batch that comes later, within a batch by the greater of the other columns.  Null keys are a key
of their own; null orders come first.  One writer at a time merges into a table, as one streaming query does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class Files:
    """What a table needs of the file system that its path is in."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, text: str, path: str) -> None:
        """The file with its whole text at once, or not at all; an error if it is there already."""
        draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        out = self.fs.create(self._path(draft), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self._path(path)) or not self.fs.rename(self._path(draft), self._path(path)):
            self.fs.delete(self._path(draft), False)
            raise FileExistsError(f"another writer has published {path}")

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class KeyedTable:
    """A table at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS):
        if {"bucket", "fresh"} & {n.lower() for n in schema.names}:
            raise ValueError("bucket and fresh are names of the table's own")
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order, self.buckets = list(keys), list(order), buckets
        self.files = Files(spark, path)

    def version(self, number: int | None = None) -> dict:
        """The latest version, or the one of a number: number, folder of each bucket, last batch of each source."""
        names = [n for n in self.files.names(f"{self.path}/versions") if n.endswith(".json")]
        if not names:
            return {"number": 0, "folders": {}, "done": {}}
        return json.loads(self.files.read(f"{self.path}/versions/{names[-1] if number is None else f'{number:012d}.json'}"))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the latest version, or of an earlier one that is still kept."""
        return self._rows(self.version(number)["folders"].values())

    def _rows(self, folders) -> DataFrame:
        folders = list(folders)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _last(self, rows: DataFrame, *before: str) -> DataFrame:
        """One row for each key: the last by the order, then by `before`, then by the other columns."""
        by = ["bucket", *self.keys]
        rest = [f.name for f in self.schema if f.name not in self.keys]
        sortable = [f.name for f in self.schema if f.name in rest and f.name not in self.order and f.dataType.typeName() not in ("map", "variant")]
        last = F.max_by(F.struct(*rest), F.struct(*self.order, *before, *sortable)).alias("last")
        return rows.groupBy(*by).agg(last).select("bucket", *(F.col(f"last.{c}").alias(c) if c in rest else c for c in self.schema.names))

    def merge(self, rows: DataFrame, batch: int | None = None, source: str = "batch") -> int:
        """Merge rows and publish; the number of the version that holds them.

        batch: a number that grows with each batch of the source; one that has been merged before is left alone.
        """
        now = self.version()
        if batch is not None and now["done"].get(source, -1) >= batch:
            return now["number"]
        name = f"{now['number'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        staged, target = f"{self.path}/staged/{name}", f"{self.path}/data/{name}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        # the batch is written once, reduced to a row a key: its buckets are read off the folders, and a retry reads the same rows
        self._last(rows.select(*self.schema.names).withColumn("bucket", bucket)).write.partitionBy("bucket").parquet(staged)
        touched = {int(n.partition("=")[2]) for n in self.files.names(staged) if n.startswith("bucket=")}
        folders = dict(now["folders"])
        if touched:
            fresh = self.spark.read.schema(self.schema).parquet(*(f"{staged}/bucket={b}" for b in sorted(touched)))
            held = self._rows(folders[str(b)] for b in sorted(touched) if str(b) in folders)
            both = held.withColumn("fresh", F.lit(0)).unionByName(fresh.withColumn("fresh", F.lit(1)))
            merged = both.withColumn("bucket", bucket).repartition(len(touched), "bucket")
            self._last(merged, "fresh").write.partitionBy("bucket").parquet(target)
            folders |= {str(b): f"{target}/bucket={b}" for b in touched}
        done = dict(now["done"]) | ({source: batch} if batch is not None else {})
        self.files.publish(json.dumps({"number": now["number"] + 1, "folders": folders, "done": done}), f"{self.path}/versions/{now['number'] + 1:012d}.json")
        self.files.delete(staged)
        return now["number"] + 1

    def follow(self, stream: DataFrame, checkpoint: str, source: str = "stream"):
        """A streaming query writer that merges every micro-batch; start() it."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: self.merge(rows, batch, source))

    def tidy(self, keep: int = 2) -> None:
        """Delete versions but the last `keep`, and files that none of those names."""
        names = [n for n in self.files.names(f"{self.path}/versions") if n.endswith(".json")]
        kept = names[-keep:]
        used = {f.split("/data/")[1].split("/")[0] for n in kept for f in json.loads(self.files.read(f"{self.path}/versions/{n}"))["folders"].values()}
        for n in names[:-keep]:
            self.files.delete(f"{self.path}/versions/{n}")
        for n in self.files.names(f"{self.path}/data"):
            if n not in used:
                self.files.delete(f"{self.path}/data/{n}")
        self.files.delete(f"{self.path}/staged")
