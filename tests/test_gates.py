"""The quality gate and the spread model against loops."""

import collections

import numpy as np
import pytest

from quantloom.frames import SPARK, spark_sql
from quantloom.operators import gates


def test_gate(spark):
    rng = np.random.default_rng(4)
    rows = []
    for symbol, bad in (("clean", 0.0), ("dirty", 0.008), ("poisoned", 0.03)):
        for day in range(3):
            for i in range(400):
                price = float(rng.choice([10.0, 11.0, 30.0], p=[0.49, 0.5, 0.01]))
                if symbol == "dirty" and i in (5, 6, 77) or symbol == "poisoned" and rng.random() < bad:
                    price = float(rng.choice([0.0, -5.0]))
                rows.append((symbol, day, day * 1000 + i, i, price, float(rng.integers(0, 10))))
    df = spark.createDataFrame(rows, "symbol string, day int, ts long, event_id long, price double, size double").repartition(3)
    got = spark_sql(spark, f"select * from {gates.gated(SPARK, '{t}')} g", t=df).cache()
    files = collections.defaultdict(list)
    for r in rows:
        files[r[:2]].append(r)
    metrics = {(r.symbol, r.day): r for r in spark_sql(spark, f"select * from {gates.gate_metrics('{g}')} m", g=got).collect()}
    kept = {(r.symbol, r.ts) for r in got.filter("kept = 1").collect()}
    want = set()
    for key, ticks in files.items():
        bad = sum(t[4] <= 0 for t in ticks)
        rejected = bad > 0.01 * len(ticks)
        prices = [t[4] for t in sorted(ticks, key=lambda t: t[2]) if t[4] > 0]
        jumps = sum(abs(b / a - 1) > 0.5 for a, b in zip(prices, prices[1:], strict=False))
        good = [] if rejected else [t for t in ticks if t[4] > 0 and t[5] != 0]
        want |= {(t[0], t[2]) for t in good}
        m = metrics[key]
        assert (m.ticks, m.bad_price, m.zero_size, m.jumps, m.rejected, m.suspect, m.kept) == (len(ticks), bad, sum(t[5] == 0 for t in ticks), jumps, int(rejected), int(jumps > 5), len(good))
    assert kept == want and {k[0] for k, m in metrics.items() if m.rejected} == {"poisoned"}


def test_spread(spark):
    rows = [(100.0, k, d, v, m, s) for k in (100.0, 90.0, 130.0) for d in (0, 6, 7, 13, 14, 60) for v in (10.0, 15.0, 35.0, 90.0) for m in (-5, 0, 30, 31, 329, 330, 390, 391) for s in (0, 1)]
    got = spark_sql(spark, f"select * from {gates.spread('{q}')} x", q=spark.createDataFrame(rows, "spot double, strike double, dte int, vix double, minutes int, strangle int")).collect()
    assert len(got) == len(rows)
    for r in got:
        at = 2.0 if not 0 <= r.minutes <= 390 else 1.5 if r.minutes <= 30 else 1.3 if r.minutes >= 330 else 1.0
        want = (0.3 if r.strangle else 0.2) * (1 + abs(r.strike - 100) / 100 * 5) * (1.3 if r.dte < 7 else 1.15 if r.dte < 14 else 1) * min(3, 1 + max(0, (r.vix - 15) / 20)) * at * (0.9 if r.strangle else 1)
        assert r.spread == pytest.approx(max(0.01, want))


def test_funnel(spark):
    import datetime

    from quantloom.operators import funnels

    rng = np.random.default_rng(8)
    start = datetime.datetime(2024, 1, 1)
    rows = [(int(rng.integers(0, 40)), str(rng.choice(["a", "b", "c", "x"], p=[0.15, 0.3, 0.2, 0.35])), start + datetime.timedelta(hours=int(h))) for h in rng.integers(0, 600, 400)]
    got = {r.step: r for r in spark_sql(spark, f"select * from {funnels.funnel('{e}', ('a', 'b', 'c'), 5, SPARK)} f", e=spark.createDataFrame(rows, "item int, stage string, ts timestamp_ntz")).collect()}
    reached = {1: [], 2: [], 3: []}
    for item in range(40):
        own = sorted((t, s) for i, s, t in rows if i == item)
        at = first = min((t for t, s in own if s == "a"), default=None)
        for k, stage in enumerate("abc", 1):
            if k > 1 and at is not None:
                at = min((t for t, s in own if s == stage and t >= at and t - first <= datetime.timedelta(days=5)), default=None)
            if at is None:
                break
            reached[k].append((at - first).total_seconds() / 3600)
    for k, hours in reached.items():
        r = got[k]
        assert (r["items"], r.median_hours) == (len(hours), pytest.approx(np.median(hours)))
        assert r.of_first == pytest.approx(100 * len(hours) / len(reached[1])) and (k == 1) == (r.of_previous is None)
    assert len(reached[1]) > len(reached[3]) > 0
