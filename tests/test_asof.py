"""Point-in-time tables against loops that only look back, and against themselves with the future cut off."""

import collections
import math

import numpy as np
import pytest

from quantloom.frames import SPARK, Series, spark_sql
from quantloom.operators import asof

S = Series(SPARK)
CUT = 70


@pytest.fixture(scope="module")
def labels():
    rng = np.random.default_rng(8)
    rows = []
    for key in "abc":
        label = "bull"
        for day in range(110):
            if rng.random() < 0.25:
                label = str(rng.choice(asof.LABELS[:3]))
            if rng.random() < 0.9:  # some days are missing
                rows.append((key, day, label))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts int, label string").repartition(3)


def runs_by_loop(rows):
    """(symbol, day) -> (label, time in the run); and closed runs as (symbol, label, length, known)."""
    at, closed, state = {}, [], {}
    for k, day, label in sorted(rows):
        was = state.get(k)
        if was and was[0] == label:
            state[k] = (label, was[1] + 1)
        else:
            if was:
                closed.append((k, was[0], was[1], day))
            state[k] = (label, 1)
        at[k, day] = state[k]
    return at, closed


def built(spark, rows, build):
    runs = spark_sql(spark, f"select * from {asof.timed_runs(S, '{rows}')} t", rows=frame(spark, rows)).cache()
    return spark_sql(spark, f"select * from {build('{runs}')} t", runs=runs).collect()


def test_duration_features(spark, labels):
    at, closed = runs_by_loop(labels)
    got = built(spark, labels, lambda r: asof.duration_features(S, r))
    assert len(got) == len(labels)
    for r in got:
        label, d = at[r.symbol, r.ts]
        known = [n for _, x, n, day in closed if x == label and day <= r.ts]
        want = (0.0, 1.0, 0.0)
        if len(known) >= 3:
            risk, over = [n for n in known if n >= d], [n for n in known if n > d]
            want = (sum(n == d for n in known) / len(risk) if risk else 1.0, len(over) / len(known), sum(n - d for n in over) / len(over) if over else 0.0)
        assert (r.label, r.time_in) == (label, d)
        assert (r.hazard, r.survival, r.remaining) == pytest.approx(want)


def test_transitions(spark, labels):
    at, _ = runs_by_loop(labels)
    steps, was = [], {}
    for k, day, label in sorted(labels):
        if k in was:
            steps.append((was[k], label, day))
        was[k] = label
    got = built(spark, labels, lambda r: asof.transitions(SPARK, S, r))
    assert len(got) == len(labels) * len(asof.LABELS)
    rows = collections.defaultdict(dict)
    for r in got:
        rows[r.symbol, r.ts][r.to_label] = r.p
    for (k, day), p in rows.items():
        label, d = at[k, day]
        seen = collections.Counter(b for a, b, t in steps if a == label and t <= day)
        h = 1.5 / 50 * (d / 50) ** 0.5
        part = {x: (1 - h) if x == label else h * seen[x] / max(sum(seen.values()), 1) for x in asof.LABELS}
        assert p == pytest.approx({x: v / sum(part.values()) for x, v in part.items()})
        assert sum(p.values()) == pytest.approx(1)


def test_transition_risk(spark, labels):
    at, closed = runs_by_loop(labels)
    for rows in (labels, [r for r in labels if r[1] < 12]):  # the few rows have too few runs
        at, closed = runs_by_loop(rows)
        for r in built(spark, rows, lambda r: asof.transition_risk(SPARK, S, r)):
            day = max(t for k, t in at if k == r.symbol)
            label, d = at[r.symbol, day]
            own = np.array([n for k, x, n, _ in closed if k == r.symbol and x == label], float)
            assert (r.ts, r.label, r.time_in, r.runs) == (day, label, d, len(own))
            if len(own) < 3:
                assert (r.hazard, r.remaining, r.percentile) == (0.05, 20, 0.5)
                continue
            mean, var = own.mean(), own.var(ddof=1)
            p = (mean - 1) / var if var > mean else 1 / mean
            n = (mean - 1) * p / (1 - p) if var > mean else 1.0
            mass = [math.gamma(x + n) / math.gamma(n) / math.factorial(x) * p**n * (1 - p) ** x for x in range(d)]
            assert r.hazard == pytest.approx(mass[-1] / (1 - sum(mass[:-1])))
            assert r.remaining == pytest.approx(max(0, n * (1 - p) / p + 1 - d))
            assert r.percentile == pytest.approx((own <= d).mean())


def patterned(spark):
    rng = np.random.default_rng(9)
    rows = []
    for key in "ab":
        days = sorted(rng.choice(300, 200, replace=False).tolist())
        seq = rng.choice(["x", "y", "z"], 200).tolist()
        regime = rng.choice([0, 1, 2], 200).tolist()
        rose = [float(rng.random() < (0.7 if q == "x" else 0.45)) for q in seq]
        for i, day in enumerate(days):
            last = i == len(days) - 1
            rows.append((key, day, seq[i] if i > 2 else None, regime[i], None if last else rose[i], None if last else days[i + 1]))
    return rows


PATTERN = "symbol string, ts int, sequence string, regime int, rose double, next_ts int"


def test_pattern_lookup(spark):
    rows = patterned(spark)
    build = lambda some: spark_sql(spark, f"select * from {asof.pattern_lookup(SPARK, S, '{r}', (0, 1, 2), 5)} t", r=spark.createDataFrame(some, PATTERN)).collect()
    got = build(rows)
    assert len(got) == len(rows)
    for r in got:
        known = [x for x in rows if x[4] is not None and x[5] <= r.ts]
        table = {}
        for g in (0, 1, 2):
            own = [x[4] for x in known if x[2] == r.sequence and x[3] == g and r.sequence is not None]
            if len(own) >= 5:
                table[g] = (sum(own) / len(own), len(own))
        base = sum(x[4] for x in known) / len(known) if known else None
        if r.regime in table:
            want = (*table[r.regime], "none")
        elif table:
            want = (sum(p for p, _ in table.values()) / len(table), sum(n for _, n in table.values()), "sequence_only")
        else:
            want = (base, 0, "base_rate")
        assert (r.support, r.fallback) == want[1:]
        assert r.p_up == (pytest.approx(want[0]) if want[0] is not None else None)
    fallbacks = {r.fallback for r in got}
    assert fallbacks == {"none", "sequence_only", "base_rate"}


def test_the_future_changes_nothing(spark, labels):
    """Rows up to a day are the same whether later days are there or not."""
    short = [r for r in labels if r[1] <= CUT]
    for build in (lambda r: asof.duration_features(S, r), lambda r: asof.transitions(SPARK, S, r)):
        names = ("symbol", "ts", "to_label", "time_in", "hazard", "survival", "remaining", "p")
        tuples = lambda rows: sorted(tuple(r[c] for c in names if c in r) for r in rows if r.ts <= CUT)
        assert tuples(built(spark, labels, build)) == tuples(built(spark, short, build))
    rows = patterned(spark)
    known = [x if x[5] is None or x[5] <= 150 else (*x[:4], None, None) for x in rows if x[1] <= 150]
    look = lambda some: sorted((r.symbol, r.ts, r.p_up, r.signal, r.fallback) for r in spark_sql(spark, f"select * from {asof.pattern_lookup(SPARK, S, '{r}', (0, 1, 2), 5)} t", r=spark.createDataFrame(some, PATTERN)).collect() if r.ts <= 150)
    assert look(rows) == look(known)
