"""Event windows and contract look-ups against loops."""

import datetime
import itertools

import numpy as np
import pytest

from quantloom.frames import SPARK, spark_sql
from quantloom.operators import contracts, events

START = datetime.datetime(2024, 3, 1)
at = lambda m: START + datetime.timedelta(seconds=round(60 * m))


@pytest.fixture(scope="module")
def calendar():
    rng = np.random.default_rng(3)
    rows = [(at(float(rng.integers(0, 20000))), f"e{rng.integers(0, 50)}", str(rng.choice(["RED", "ORANGE", "YELLOW", "GREY"]))) for _ in range(60)]
    return rows + [(at(500), "b", "ORANGE"), (at(500), "a", "ORANGE"), (at(500), "z", "RED"), (None, "never", "RED")]


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(4)
    return [("x", at(m)) for m in sorted({float(v) for v in rng.integers(0, 20500, 900) / 2})] + [("y", at(470)), ("y", at(469.9)), ("y", at(560)), ("y", at(560.1)), ("y", at(500))]


def run(spark, build, calendar, bars):
    frames = {"c": spark.createDataFrame(calendar, "due timestamp_ntz, name string, impact string"), "b": spark.createDataFrame(bars, "symbol string, ts timestamp_ntz")}
    df = spark_sql(spark, f"select * from {build} x", **frames)
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
    return {(r.symbol, r.ts): r for r in df.collect()}


def gravest(calendar, due):
    order = {x: k for k, x in enumerate(events.IMPACTS)}
    return min((order.get(i, 3), n, i) for d, n, i in calendar if d == due)


def test_event_windows(spark, calendar, bars):
    got = run(spark, events.event_windows(SPARK, "{b}", ("symbol",), "{c}"), calendar, bars)
    for symbol, ts in bars:
        inside = [d for d, _, _ in calendar if d and d - datetime.timedelta(minutes=30) <= ts <= d + datetime.timedelta(minutes=60)]
        assert ((symbol, ts) in got) == bool(inside)
        if inside:
            r, due = got[symbol, ts], min(inside)
            m = (due - ts).total_seconds() / 60
            assert (r.due, r.events, r.minutes) == (due, len(inside), pytest.approx(m))
            assert (r.impact, r.name) == gravest(calendar, due)[:0:-1]
            if abs(m) % 1 != 0.5:
                assert r.position == f"T{'-' if m > 0 else '+'}{abs(m):.0f}m"
    assert got["y", at(470)].name == "z" and ("y", at(469.9)) not in got and ("y", at(560)) in got and ("y", at(560.1)) not in got


def test_upcoming(spark, calendar, bars):
    got = run(spark, events.upcoming(SPARK, "{b}", ("symbol",), "{c}", 5), calendar, bars)
    for symbol, ts in bars:
        ahead = [d for d, _, _ in calendar if d and ts <= d <= ts + datetime.timedelta(hours=5)]
        assert ((symbol, ts) in got) == bool(ahead)
        if ahead:
            r, m = got[symbol, ts], (min(ahead) - ts).total_seconds() / 60
            assert (r.due, r.events) == (min(ahead), len(ahead)) and abs(r.minutes_until - m) <= 0.5
            assert r.tighten == int(r.hours_until <= 2) and abs(r.hours_until - m / 60) <= 0.051


@pytest.fixture(scope="module")
def chain():
    rng = np.random.default_rng(5)
    rows = []
    for symbol, day, opt in itertools.product("ab", (1, 2), "CP"):
        for dte in sorted(set(rng.integers(1, 200, 5).tolist())):
            rows += [(symbol, day, opt, int(dte), float(k), float(rng.random()), int(rng.integers(1, 99))) for k in sorted(set((rng.integers(20, 3000, 12) / 4).tolist()))]
    rows.append(("a", 1, "C", 300, 100.0, 1.0, 1))  # ties in expiry: 300 and 304 are as near to 302
    rows += [("a", 1, "C", 304, 99.0, 2.0, 2), ("a", 1, "C", 304, 101.0, 3.0, 3)]
    return rows


@pytest.fixture(scope="module")
def wanted(chain):
    rng = np.random.default_rng(6)
    rows = [(i, str(rng.choice(["a", "b", "none"])), int(rng.integers(1, 4)), str(rng.choice(["C", "P"])), int(rng.integers(1, 420)), float(rng.integers(0, 9000) / 4)) for i in range(600)]
    rows += [(1000 + i, *c[:4], c[4] + off) for i, (c, off) in enumerate(itertools.product(chain[::7], (0.0, 0.0099, -0.0099, 0.0101)))]
    rows += [(5000, "a", 1, "C", 302, 99.6), (5001, "a", 1, "C", 302, 100.0), (5002, "a", 1, "C", 303, 100.0)]
    return rows


def look(spark, build, wanted, chain):
    frames = {"w": spark.createDataFrame(wanted, "id long, symbol string, ts int, opt string, dte int, strike double"), "c": spark.createDataFrame(chain, "symbol string, ts int, opt string, dte int, strike double, price double, oi int")}
    rows = spark_sql(spark, f"select * from {build} x", **frames).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r for r in rows}


def test_exact_and_bulk(spark, wanted, chain):
    got = look(spark, contracts.exact(SPARK, "{w}", "{c}", ("price", "oi")), wanted, chain)
    bulk = look(spark, contracts.bulk("{w}", "{c}", ("price",)), wanted, chain)
    assert len(got) == len(wanted)
    hits = 0
    for i, symbol, ts, opt, dte, strike in wanted:
        near = [c for c in chain if c[:4] == (symbol, ts, opt, dte) and abs(c[4] - strike) < 0.01]
        best = min(near, key=lambda c: c[4], default=(None,) * 7)
        assert (got[i].found_strike, got[i].price, got[i].oi) == (best[4], best[5], best[6])
        same = [c[5] for c in chain if c[:5] == (symbol, ts, opt, dte, strike)]
        assert (i in bulk) == bool(same) and (not same or bulk[i].price == same[0])
        hits += bool(near)
    assert hits > 50


def test_nearest(spark, wanted, chain):
    got = look(spark, contracts.nearest(SPARK, "{w}", "{c}", ("price",)), wanted, chain)
    assert len(got) == len(wanted)
    found = 0
    for i, symbol, ts, opt, dte, strike in wanted:
        day = [c for c in chain if c[:3] == (symbol, ts, opt)]
        best = min(day, key=lambda c: (abs(c[3] - dte), abs(c[4] - strike), c[3], c[4]), default=None)
        if best is None or abs(best[3] - dte) > 90 or abs(best[4] - strike) > 500:
            assert got[i].found_strike is None
        else:
            assert (got[i].found_dte, got[i].found_strike, got[i].price) == (best[3], best[4], best[5])
            assert (got[i].days_off, got[i].strike_off) == (abs(best[3] - dte), pytest.approx(abs(best[4] - strike)))
            found += 1
    assert found > 150 and found < len(wanted)
    assert (got[5000].found_dte, got[5000].found_strike) == (300, 100.0)
