"""Operators as functions over any DataFrame: no look-ahead, keys apart, invariants."""

import datetime

import pytest
from pyspark.sql import functions as F

from quantloom.frames import apply
from quantloom.operators import bars, flow, regimes
from quantloom.sources import files
from quantloom.streaming import streams


@pytest.fixture(scope="module")
def frame(spark):
    day = F.expr("date_add(date '2020-01-01', cast(i as int))").cast("timestamp")
    rows = spark.range(300).withColumnRenamed("id", "i").crossJoin(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "symbol string, k double"))
    close = F.lit(100) + F.col("k") * 10 * F.sin(F.col("i") / 7) + F.col("i") / 10
    return rows.select("symbol", day.alias("ts"), (close - 1).alias("open"), (close + 2).alias("high"), (close - 2).alias("low"), close.alias("close"), (F.lit(100.0) + F.col("i") % 13).alias("volume")).cache()


@pytest.mark.parametrize("op", [bars.returns, bars.rolling_stats, bars.gain_loss, bars.rsi, bars.structure, bars.realized_vol, flow.bulk_volume, flow.price_impact, regimes.trend_regime, bars.momentum_backtest])
def test_point_in_time(frame, op):
    cut = datetime.datetime(2020, 8, 1)
    whole = apply(op, frame).filter(F.col("ts") <= cut)
    part = apply(op, frame.filter(F.col("ts") <= cut))
    assert sorted(map(str, whole.collect())) == sorted(map(str, part.collect()))


@pytest.mark.parametrize("op", [bars.returns, flow.bulk_volume, regimes.trend_regime])
def test_keys_are_apart(frame, op):
    both = apply(op, frame).filter("symbol = 'a'")
    alone = apply(op, frame.filter("symbol = 'a'"))
    assert sorted(map(str, both.collect())) == sorted(map(str, alone.collect()))


def test_buying_and_selling_add_up(frame):
    assert apply(flow.bulk_volume, frame).filter(F.abs(F.col("buy_volume") + F.col("sell_volume") - F.col("volume")) > 1e-6).count() == 0


def test_contracts(spark):
    df = spark.createDataFrame([("O:SPY240119C00450000",), ("O:BRK.B240119P00300500",), ("bad",), (None,)], "ticker string")
    rows = files.parse_contract(df).orderBy("root").collect()
    assert [(r.root, str(r.expiry), r.opt, r.strike) for r in rows] == [("BRK.B", "2024-01-19", "P", 300.5), ("SPY", "2024-01-19", "C", 450.0)]


def test_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 0.5, 1.5)], "Timestamp long, O double, High double, l double, close double")
    assert set(files.normalize_columns(df).columns) == {"ts", "open", "high", "low", "close", "volume"}
    with pytest.raises(ValueError):
        files.normalize_columns(df.drop("close"))


def test_store(spark, frame, tmp_path):
    files.write_partitioned(frame.filter("ts < '2020-01-05'"), str(tmp_path / "store"))
    back = spark.read.parquet(str(tmp_path / "store"))
    assert back.count() == 8
    days = frame.select("symbol", F.to_date("ts").alias("date")).distinct()
    assert files.missing_days(days, back).count() == days.count() - 8


def test_feed(spark):
    raw = spark.createDataFrame([('{"symbol":"a","price":1.5,"size":2,"date":20240102,"ms_of_day":1000,"sequence":1}',), ("{bad",), ('{"symbol":"a","price":-1,"size":2,"date":20240102,"ms_of_day":1,"sequence":2}',)], "value string")
    rows = streams.parse_feed(raw).collect()
    assert [(r.symbol, r.price, str(r.ts)) for r in rows] == [("a", 1.5, "2024-01-02 00:00:01")]
