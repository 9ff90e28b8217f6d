"""Recursions over streams: rows of a key in the order of their time, a state carried between micro-batches.

Rows wait in the state, by bins of time, until the watermark has passed them, so that they are taken in order however they arrive;
a timer of the earliest waiting row wakes the key, and its rows are taken a bin at a time.  The recursion's state is a value of the key's state, and comes back after a restart
from the checkpoint.  The rows that come out are those that `recursions.scan` gives in batch, up to the watermark.

Rows behind the watermark when they arrive are late and go, as in every operator with a watermark.

A feed that has ended leaves rows that no watermark passes.  Its end is said by a mark: a row of a second stream, later than
all rows, which moves the watermark and has no other effect.  See `Marks`.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MARK = "_mark"
#: Seconds of a bin of waiting rows: a task holds the rows of a key and a bin.
BIN = 21_600


class Marks:
    """Times up to which a feed is known to be whole, as a stream of files in a folder."""

    SCHEMA = "ts timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.SCHEMA).parquet(self.path)

    def end(self, rows: DataFrame, late: str = "10 minutes") -> None:
        """Say that no row comes after those of a batch: a mark that moves a watermark of `late` past all of them."""
        last = rows.agg(F.max("ts").alias("ts")).filter("ts is not null")
        last.select((F.col("ts") + F.expr(f"interval {late}") + F.expr("interval 1 second")).alias("ts")).write.mode("append").parquet(self.path)


class _Carried(StatefulProcessor):
    def __init__(self, start: Callable[[], object], columns: list[str], order: list[str], added: list[str]):
        self.start, self.columns, self.order, self.added = start, columns, order, added

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value binary")
        self.parts = handle.getValueState("parts", "value long")
        self.waiting = handle.getMapState("waiting", "bin long, part long", "value binary")

    def _wait(self, rows: pd.DataFrame) -> pd.Timestamp:
        """Rows wait as a part of each bin of time that they touch, so that a bin is read without the others."""
        number = self.parts.get()[0] if self.parts.exists() else 0
        for bin_, part in rows.groupby(rows["ts"].astype("datetime64[s]").astype("int64") // BIN):
            self.waiting.updateValue((int(bin_), number), (pickle.dumps(part),))
        self.parts.update((number + 1,))
        return rows["ts"].min()

    def _wake(self, first: pd.Timestamp) -> None:
        self.handle.registerTimer(int(first.value // 1_000_000) + 1)

    def _push(self, recursion: object, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        return recursion.push({c: rows[c].to_numpy(float) for c in self.columns if pd.api.types.is_numeric_dtype(rows[c])})

    def _keep(self, recursion: object) -> None:
        self.state.update((pickle.dumps(recursion),))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        recursion = pickle.loads(self.state.get()[0]) if self.state.exists() else self.start()
        self._push(recursion, initialState.sort_values(self.order, kind="stable"))
        self._keep(recursion)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for new in rows:  # a batch at a time
            new.columns = [*self.columns, _MARK]  # a constant column comes without its name
            new = new[~new[_MARK].astype(bool) & new["ts"].notna()]
            if len(new):
                first.append(self._wait(new[self.columns]))
        if first:
            self._wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        keys = sorted(self.waiting.keys())
        recursion = None
        for bin_, group in itertools.groupby(keys, lambda k: k[0]):
            own = list(group)
            if bin_ * BIN >= passed.timestamp():
                self._wake(pd.Timestamp(bin_ * BIN, unit="s"))
                break
            rows = pd.concat([pickle.loads(self.waiting.getValue(k)[0]) for k in own])
            for k in own:
                self.waiting.removeKey(k)
            ready = rows["ts"] < passed
            left, rows = rows[~ready], rows[ready].sort_values(self.order, kind="stable")
            if len(left):
                first = self._wait(left)
            if len(rows):
                if recursion is None:
                    recursion = pickle.loads(self.state.get()[0]) if self.state.exists() else self.start()
                got = self._push(recursion, rows)
                yield rows.assign(**{c: np.asarray(got[c], float) for c in self.added})
            if len(left):
                self._wake(first)
                break
        if recursion is not None:
            self._keep(recursion)


def scan_stream(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object], added: str, late: str = "10 minutes", history: DataFrame | None = None, marks: Marks | None = None) -> DataFrame:
    """A stream of rows with the columns that a recursion adds, once the watermark has passed them.

    rows: keys, ts (timestamp) and other columns; order: begins with ts and is total within a key; start and added as for
    `recursions.scan`.  history: rows of the same columns from before the stream, from which its state starts; a key's
    history is read by one task, so that no more of it should be given than the recursion remembers.  marks: what the watermark
    follows beside the rows.  The session's state store must be RocksDB: see `state_store`.
    """
    columns = [f.name for f in rows.schema]
    new = StructType.fromDDL(added)
    processor = _Carried(start, columns, list(order), [f.name for f in new])
    marked = rows.withColumn(_MARK, F.lit(False))
    if marks is not None:
        marked = marked.unionByName(marks.stream().withColumn(_MARK, F.lit(True)), allowMissingColumns=True)
    marked = marked.withWatermark("ts", late)
    return marked.groupBy(*keys).transformWithStateInPandas(processor, StructType([*rows.schema, *new]), "Append", "EventTime", initialState=history.select(*columns).groupBy(*keys) if history is not None else None)


@contextmanager
def state_store(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which transformWithState needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)
