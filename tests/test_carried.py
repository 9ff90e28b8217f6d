"""Streams with carried state against the same recursion in batch, out of order and over restarts."""

import datetime
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import recursions as R
from quantloom.streaming import carried, streams

SCHEMA = "symbol string, ts timestamp, event_id long, close double"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def feed(spark):
    """Rows that arrive up to eight minutes late, in files; and the rows."""
    rng = np.random.default_rng(6)
    rows = [(s, START + datetime.timedelta(seconds=45 * i + (s == "b") * 7), 2 * i + (s == "b"), float(rng.normal(0 if i < 90 else 4, 1))) for i in range(180) for s in "ab"]
    arrived = sorted(rows, key=lambda r: r[1] + datetime.timedelta(minutes=8 * rng.random()))
    return rows, [arrived[k : k + 90] for k in range(0, len(arrived), 90)]


def write(spark, path, part):
    spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def drain(spark, source, start, added, path, history=None, column="close", marks=None):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).withColumnRenamed("close", column)
    found = carried.scan_stream(rows, ["symbol"], ["ts", "event_id"], start, added, history=history, marks=marks)
    with carried.state_store(spark):
        q = found.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{path}/out")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def table(df, names):
    out = {}
    for r in df.collect():
        assert (r.symbol, r.event_id) not in out
        out[r.symbol, r.event_id] = [r[c] for c in names]
    return out


@pytest.mark.parametrize(("start", "added"), [(R.RunLengths, "change double, run_length double, mean double"), (lambda: R.Exposure(4), "exposure double, was double, side double")])
def test_equals_batch_over_restarts(spark, feed, start, added):
    rows, parts = feed
    names = [c.split()[0] for c in added.split(", ")]
    column = "x" if start is R.RunLengths else "signed" if "exposure" in names else "close"
    source, path = tempfile.mkdtemp(prefix="feed-"), tempfile.mkdtemp(prefix="carried-")
    for part in parts:  # each call starts the query anew from its checkpoint
        write(spark, source, part)
        got = drain(spark, source, start, added, path, column=column)
    batch = table(R.scan(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("close", column), ("symbol",), ("ts", "event_id"), start, added), names)
    passed = max(r[1] for r in rows) - datetime.timedelta(minutes=10)
    want = {k: v for k, v in batch.items() if next(r[1] for r in rows if r[2] == k[1]) < passed}
    found = table(got, names)
    assert set(found) == set(want) and len(want) > 300
    for k, v in want.items():
        np.testing.assert_allclose(found[k], v, rtol=1e-9, atol=1e-12)


def test_state_starts_from_history(spark, feed):
    rows, _ = feed
    cut = START + datetime.timedelta(hours=1)
    old, new = [r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]
    source, path = tempfile.mkdtemp(prefix="feed-"), tempfile.mkdtemp(prefix="carried-")
    write(spark, source, new[:40])
    history = streams.last_rows(spark.createDataFrame(old, SCHEMA), 7)
    drain(spark, source, lambda: R.LastMean(7), "mean double, n double", path, history)
    write(spark, source, new[40:])
    got = table(drain(spark, source, lambda: R.LastMean(7), "mean double, n double", path, history), ["mean", "n"])
    batch = table(R.scan(spark.createDataFrame(rows, SCHEMA), ("symbol",), ("ts", "event_id"), lambda: R.LastMean(7), "mean double, n double"), ["mean", "n"])
    passed = max(r[1] for r in rows) - datetime.timedelta(minutes=10)
    assert set(got) == {(r[0], r[2]) for r in new if r[1] < passed}
    for k, v in got.items():
        np.testing.assert_allclose(v, batch[k])


def test_moves_and_exposure():
    x = np.array([1.0, 2, 3, 4, 3, 2, 1, 1, 2])
    whole = R.Moves(3).push({"close": x})["signal"]
    assert whole.tolist() == [0, 0, 0, 1, 0, 0, -1, 0, 0]
    m = R.Moves(3)
    assert np.concatenate([m.push({"close": p})["signal"] for p in (x[:1], x[1:5], x[5:])]).tolist() == whole.tolist()
    e = R.Exposure(3)
    got = [e.push({"signed": p}) for p in (np.array([1.0, -4]), np.array([1.0, 9, -1]))]
    assert np.concatenate([g["exposure"] for g in got]).tolist() == [1, -3, -2, 6, 9]
    assert np.concatenate([g["was"] for g in got]).tolist() == [0, 1, -1, -1, 1]


def test_late_rows_go(spark):
    source, path = tempfile.mkdtemp(prefix="feed-"), tempfile.mkdtemp(prefix="carried-")
    minute = lambda m: START + datetime.timedelta(minutes=m)
    for part in ([("a", minute(0), 1, 1.0), ("a", minute(60), 2, 2.0)], [("a", minute(5), 3, 9.0), ("a", minute(90), 4, 3.0)]):
        write(spark, source, part)
        got = drain(spark, source, lambda: R.LastMean(7), "mean double, n double", path)
    assert sorted((r.event_id, r.mean) for r in got.select("event_id", F.col("mean")).collect()) == [(1, 1.0), (2, 1.5)]


def test_mark_ends_a_feed(spark, feed):
    rows, _ = feed
    source, path = tempfile.mkdtemp(prefix="feed-"), tempfile.mkdtemp(prefix="carried-")
    marks = carried.Marks(spark, f"{path}/marks")
    write(spark, source, rows)
    waiting = drain(spark, source, lambda: R.LastMean(7), "mean double, n double", path, marks=marks).count()
    marks.end(spark.createDataFrame(rows, SCHEMA))
    got = table(drain(spark, source, lambda: R.LastMean(7), "mean double, n double", path, marks=marks), ["mean", "n"])
    batch = table(R.scan(spark.createDataFrame(rows, SCHEMA), ("symbol",), ("ts", "event_id"), lambda: R.LastMean(7), "mean double, n double"), ["mean", "n"])
    assert waiting < len(rows) and set(got) == set(batch) and len(batch) == len(rows)
    for k, v in got.items():
        np.testing.assert_allclose(v, batch[k])


def test_warm_up_gives_every_live_row(spark, sf):
    from quantloom import plans

    got = {r.event_id: (r.n, r["mean"]) for r in plans.QUERIES["t04_warm_up"](spark, sf).collect()}
    kept, want = {}, {}
    for e in sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda e: (e.ts, e.event_id)):
        last = kept[e.event_type] = [*kept.get(e.event_type, []), e.value][-20:]
        if e.ts >= datetime.datetime(2024, 1, 15):
            want[e.event_id] = (len(last), sum(last) / len(last))
    assert set(got) == set(want) and len(want) > 300
    for k, (n, mean) in want.items():
        assert got[k][0] == n and abs(got[k][1] - mean) < 1e-6


def test_signals_of_every_closed_bar(spark, sf):
    from quantloom import plans

    got = sorted((r.symbol, r.ts, r.close) for r in plans.QUERIES["t09_stream_signals"](spark, sf).collect())
    bars = sorted((r.symbol, r.ts, r.close) for r in plans.QUERIES["t01_stream_bars"](spark, sf).collect())
    assert got == bars and len(bars) > 300
