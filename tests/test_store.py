"""Keyed tables: merges, replays, crashes and readers."""

import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.sources.store import KeyedTable

SCHEMA = "symbol string, day int, seq long, value double, tags array<string>"


@pytest.fixture
def table(spark):
    path = tempfile.mkdtemp(prefix="store-")
    return KeyedTable(spark, f"{path}/t", StructType.fromDDL(SCHEMA), ["symbol", "day"], ["seq"], buckets=5)


def rows(df):
    return sorted((tuple(r[:4]) for r in df.collect()), key=str)


def batch(spark, *values):
    return spark.createDataFrame([(*v, ["x"]) for v in values], SCHEMA)


def test_merges_like_the_latest_row_per_key(spark, table):
    assert table.read().count() == 0
    parts = [[(f"s{(i * 7 + k) % 11}", i % 3, i * 3 % 40 + k, float(i)) for i in range(30)] for k in range(4)]
    want = {}
    for k, part in enumerate(parts):
        assert table.merge(batch(spark, *part), k) == k + 1
        for s, d, q, v in sorted(part, key=lambda r: (r[2], r[3])):  # in a batch the greater value wins a tie; later batches win over earlier ones
            if (s, d) not in want or want[s, d][0] <= q:
                want[s, d] = (q, v)
        assert rows(table.read()) == sorted(((s, d, q, v) for (s, d), (q, v) in want.items()), key=str)
    assert rows(table.read(1)) != rows(table.read(2))  # earlier versions stay readable
    before = rows(table.read())
    table.tidy(1)
    assert rows(table.read()) == before and len(table.files.names(f"{table.path}/versions")) == 1


def test_replays_change_nothing(spark, table):
    table.merge(batch(spark, ("a", 1, 5, 1.0)), 0, "one")
    table.merge(batch(spark, ("a", 1, 4, 9.0), ("b", 1, 1, 2.0)), 1, "one")
    at, data = table.version(), rows(table.read())
    assert data == [("a", 1, 5, 1.0), ("b", 1, 1, 2.0)]
    assert table.merge(batch(spark, ("a", 1, 99, 99.0)), 1, "one") == at["number"]
    assert table.version() == at and rows(table.read()) == data
    table.merge(batch(spark, ("a", 1, 6, 3.0)), 1, "two")  # another source counts for itself
    assert ("a", 1, 6, 3.0) in rows(table.read())


def test_only_touched_buckets_are_rewritten(spark, table):
    table.merge(batch(spark, *((f"s{i}", i, 1, 0.0) for i in range(60))))
    old = table.version()["folders"]
    assert len(old) == 5
    table.merge(batch(spark, ("s1", 1, 2, 7.0)))
    new = table.version()["folders"]
    assert sum(old[b] != new[b] for b in old) == 1 and table.read().count() == 60


def test_a_merge_that_dies_is_not_seen(spark, table, monkeypatch):
    table.merge(batch(spark, ("a", 1, 1, 1.0), ("b", 1, 1, 1.0)), 0)
    data = rows(table.read())
    reader = table.read()
    with monkeypatch.context() as m:
        m.setattr(table.files, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            table.merge(batch(spark, ("a", 1, 2, 2.0), ("b", 1, 2, 2.0)), 1)
    assert rows(table.read()) == data and table.version()["done"] == {"batch": 0}
    table.merge(batch(spark, ("a", 1, 2, 2.0), ("b", 1, 2, 2.0)), 1)
    assert rows(table.read()) == [("a", 1, 2, 2.0), ("b", 1, 2, 2.0)]
    assert rows(reader) == data  # a reader that began before goes on with its version
    table.tidy(1)
    assert rows(table.read()) == [("a", 1, 2, 2.0), ("b", 1, 2, 2.0)]


def test_two_writers(spark, table):
    table.merge(batch(spark, ("a", 1, 1, 1.0)))
    with pytest.raises(FileExistsError):
        table.files.publish("{}", f"{table.path}/versions/{1:012d}.json")


def test_null_keys_and_empty_batches(spark, table):
    table.merge(batch(spark, (None, None, 1, 1.0), (None, None, 2, 2.0), ("a", None, None, 3.0)))
    table.merge(batch(spark).limit(0), 0)
    assert rows(table.read()) == sorted([(None, None, 2, 2.0), ("a", None, None, 3.0)], key=str)


def test_follows_a_stream_over_restarts(spark, table):
    source = tempfile.mkdtemp(prefix="feed-")
    for k in range(3):
        batch(spark, *((f"s{i}", 0, k, float(10 * k + i)) for i in range(k, k + 4))).coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        table.follow(feed, f"{table.path}-state").trigger(availableNow=True).start().awaitTermination()
    assert rows(table.read()) == [("s0", 0, 0, 0.0), ("s1", 0, 1, 11.0), *((f"s{i}", 0, 2, 20.0 + i) for i in range(2, 6))]
    assert table.version()["done"] == {"stream": 2}
    everything = spark.read.schema(SCHEMA).parquet(source)
    assert rows(table.read()) == rows(everything.groupBy("symbol", "day").agg(F.max_by(F.struct("seq", "value"), "seq").alias("x")).select("symbol", "day", "x.*"))
