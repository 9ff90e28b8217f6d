"""Timeframes rolled up level by level against a direct grouping of the ticks."""

import collections
import datetime

import numpy as np
import pytest

from quantloom.frames import SPARK, spark_sql
from quantloom.operators import rollup

START = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def ticks():
    rng = np.random.default_rng(7)
    rows = []
    for symbol in "ab":
        for i in range(1500):
            at = START + datetime.timedelta(seconds=int(rng.integers(0, 3 * 86400)))
            rows.append((symbol, at, i, float(rng.integers(1, 500)) if rng.random() > 0.02 else None, float(rng.integers(0, 9))))
    return rows


@pytest.fixture(scope="module")
def states(spark, ticks):
    df = spark.createDataFrame(ticks, "symbol string, ts timestamp_ntz, event_id long, price double, size double").repartition(4)
    return spark_sql(spark, f"select * from {rollup.bar_states(SPARK, '{t}', 5)} x", t=df).cache()


def bars(ticks, minutes):
    out = collections.defaultdict(list)
    for symbol, at, i, price, size in ticks:
        if price is not None:
            day = datetime.datetime.combine(at.date(), datetime.time())
            out[symbol, day + datetime.timedelta(minutes=(at - day).seconds // 60 // minutes * minutes)].append((at, i, price, size))
    result = {}
    for key, rows in out.items():
        rows.sort()
        prices, sizes = [r[2] for r in rows], [r[3] for r in rows]
        value = sum(p * s for p, s in zip(prices, sizes, strict=True))
        result[key] = (prices[0], max(prices), min(prices), prices[-1], sum(sizes), value / sum(sizes) if sum(sizes) else None, len(rows))
    return result


def test_every_level_equals_a_direct_grouping(spark, ticks, states):
    got = collections.defaultdict(dict)
    for r in spark_sql(spark, f"select * from {rollup.timeframe_bars(SPARK, '{s}')} x", s=states).collect():
        got[r.timeframe][r.symbol, r.ts] = (r.open, r.high, r.low, r.close, r.volume, r.vwap, r.n)
    assert set(got) == set(rollup.TIMEFRAMES)
    for name, minutes in rollup.TIMEFRAMES.items():
        want = bars(ticks, minutes)
        assert set(got[name]) == set(want)
        for key, bar in want.items():
            assert got[name][key] == pytest.approx(bar, nan_ok=True) if None not in bar else got[name][key] == bar


def test_alignment(spark, ticks, states):
    features = spark_sql(spark, f"select * from {rollup.timeframe_features(SPARK, '{s}')} x", s=states).cache()
    last = spark_sql(spark, f"select * from {rollup.last_of_day(SPARK, '{f}', ('ret_5', 'momentum'))} x", f=features).cache()
    want = {}
    for name, minutes in rollup.TIMEFRAMES.items():
        for symbol in "ab":
            own = sorted((k[1], v[3]) for k, v in bars(ticks, minutes).items() if k[0] == symbol)
            close = np.array([c for _, c in own])
            for i, (at, c) in enumerate(own):
                day = datetime.datetime.combine(at.date(), datetime.time())
                old = want.get((name, symbol, day), (None, None))
                want[name, symbol, day] = (c / close[i - 5] - 1 if i >= 5 else old[0], c / close[i - 9 : i + 1].mean() - 1 if i >= 9 else old[1])
    rows = {(r.timeframe, r.symbol, r.day): (r.ret_5, r.momentum) for r in last.collect()}
    assert set(rows) == set(want)
    for k, v in want.items():
        for a, b in zip(rows[k], v, strict=True):
            assert a is None if b is None else a == pytest.approx(b)
    sign = lambda x: None if x is None else int(x > 0) - int(x < 0)
    names = list(rollup.TIMEFRAMES)
    got = spark_sql(spark, f"select * from {rollup.alignment(SPARK, '{d}')} x", d=last).collect()
    assert len(got) == 6
    for r in got:
        values = [want[n, r.symbol, r.day] for n in names]
        for column, k in (("align", 0), ("momentum_align", 1)):
            agree = [int(None not in (values[i][k], values[i + 1][k]) and sign(values[i][k]) == sign(values[i + 1][k])) for i in range(3)]
            assert [r[f"{column}_{i}"] for i in range(3)] == agree
        assert r.cascade == r.align_0 * r.align_1 * r.align_2
        assert r.strength_0 == pytest.approx(values[0][0] * values[1][0])
