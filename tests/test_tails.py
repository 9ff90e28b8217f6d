"""Tails against known values, exact sums in whole numbers, and draws."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from quantloom.frames import DUCK, SPARK, spark_sql
from quantloom.operators import tails


def both(spark, build, rows, schema):
    """Rows of a relation over (rows) from both engines."""
    got = spark_sql(spark, f"select * from {build(SPARK, '{r}')} t", r=spark.createDataFrame(rows, schema)).collect()
    names = [c.split()[0] for c in schema.split(",")]
    values = ", ".join("(" + ", ".join(f"cast({v!r} as double)" if isinstance(v, float) else repr(v) for v in row) + ")" for row in rows)
    cur = duckdb.connect().execute(f"select * from {build(DUCK, f'(select * from (values {values}) v({', '.join(names)}))')} t")
    cols = [c[0] for c in cur.description]
    return [r.asDict() for r in got], [dict(zip(cols, r, strict=True)) for r in cur.fetchall()]


#: Two-sided p-values of published tables of Student's t: 12.706 at 1 degree of freedom is the 5 % point, and so on.
T = [(12.706205, 1.0, 0.05), (2.228139, 10.0, 0.05), (3.169273, 10.0, 0.01), (2.042272, 30.0, 0.05), (1.959964, 1e9, 0.05), (1.983972, 100.0, 0.05), (0.0, 5.0, 1.0), (1.0, 1.0, 0.5), (-1.0, 1.0, 0.5)]


def test_t(spark):
    for got in both(spark, lambda d, r: tails.t_tail(d, r, "p", "t", "df"), [(a, b) for a, b, _ in T[:4] + T[5:]], "t double, df double"):
        want = {(a, b): p for a, b, p in T}
        assert len(got) == len(T) - 1
        for r in got:
            assert r["p"] == pytest.approx(want[r["t"], r["df"]], abs=1e-6)


def test_t_by_quadrature(spark):
    cases = [(t, df) for t in (0.3, 1.7, 4.4) for df in (2.0, 3.5, 17.0, 400.0, 25000.0)]
    for got in both(spark, lambda d, r: tails.t_tail(d, r, "p", "t", "df"), cases, "t double, df double"):
        for r in got:
            t, v = r["t"], r["df"]
            u = (np.arange(2_000_000) + 0.5) / 2_000_000  # the density's inside of (-t, t), by the midpoint rule
            x = u * t
            c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
            assert r["p"] == pytest.approx(1 - 2 * t * np.mean(c * (1 + x * x / v) ** (-(v + 1) / 2)), abs=1e-8)


#: Upper 5 % and 1 % points of F of published tables.
F_POINTS = [(4.964603, 1.0, 10.0, 0.05), (3.325835, 5.0, 10.0, 0.05), (2.533555, 5.0, 30.0, 0.05), (5.636326, 5.0, 10.0, 0.01), (161.447639, 1.0, 1.0, 0.05), (0.0, 3.0, 4.0, 1.0)]


def test_f(spark):
    for got in both(spark, lambda d, r: tails.f_tail(d, r, "p", "f", "a", "b"), [x[:3] for x in F_POINTS], "f double, a double, b double"):
        for r in got:
            assert r["p"] == pytest.approx({x[:3]: x[3] for x in F_POINTS}[r["f"], r["a"], r["b"]], abs=1e-6)


def hypergeometric(tp, fp, fn, tn):
    n, hit, pos = tp + fp + fn + tn, tp + fp, tp + fn
    return float(sum(Fraction(math.comb(pos, k) * math.comb(n - pos, hit - k), math.comb(n, hit)) for k in range(tp, min(hit, pos) + 1)))


TABLES = [(5, 3, 4, 8), (0, 3, 4, 8), (8, 0, 0, 9), (40, 20, 300, 500), (1, 0, 0, 0), (700, 300, 2000, 4000), (2, 30, 40, 1), (0, 0, 5, 5)]


def test_permutations(spark):
    for got in both(spark, lambda d, r: tails.permutation_tail(d, r, "p", "tp", "fp", "fn", "tn"), TABLES, "tp int, fp int, fn int, tn int"):
        assert len(got) == len(TABLES)
        for r in got:
            assert r["p"] == pytest.approx(hypergeometric(r["tp"], r["fp"], r["fn"], r["tn"]), abs=1e-9)


def test_permutations_agree_with_draws(spark):
    rng = np.random.default_rng(3)
    table = (30, 20, 60, 90)
    tp, fp, fn, tn = table
    labels = np.repeat([1, 0], [tp + fn, fp + tn])
    hits = np.zeros(200, bool)
    hits[:50] = True
    share = np.mean([(2 * rng.permutation(labels)[hits] - 1).sum() >= tp - fp for _ in range(1000)])
    p = both(spark, lambda d, r: tails.permutation_tail(d, r, "p", "tp", "fp", "fn", "tn"), [table], "tp int, fp int, fn int, tn int")[0][0]["p"]
    assert abs(share - p) < 4 * math.sqrt(p * (1 - p) / 1000)


def test_resamplings(spark):
    rng = np.random.default_rng(4)
    rows = [(1, 10, 4), (2, 300, 260), (3, 0, 5), (4, 7, 0), (5, 4000, 3900), (6, 0, 0), (7, 2, 900)]
    for got in both(spark, lambda d, r: tails.resampled_tail(d, r, "i"), rows, "i int, tp int, fp int"):
        assert len(got) == len(rows)
        for r in got:
            _, a, b = rows[r["i"] - 1]
            share = np.mean(rng.poisson(a, 200_000) <= rng.poisson(b, 200_000))
            assert r["p_below"] == pytest.approx(share, abs=0.006)
        exact = {r["i"]: r["p_below"] for r in got}
        assert exact[4] == pytest.approx(math.exp(-7), rel=1e-9) and exact[6] == pytest.approx(1)


def test_threshold_search(spark):
    """Welch's t of the rows above each percentile, by loops over the rows."""
    from quantloom.operators import evaluation

    rng = np.random.default_rng(5)
    rows = [(k, float(x), float(0.3 * (x > 0.4) + rng.normal(0, 1))) for k in "ab" for x in rng.normal(0, 1, 150 if k == "a" else 45).round(2)]
    got = spark_sql(spark, f"select * from {evaluation.threshold_search(SPARK, '{r}', 'k')} t", r=spark.createDataFrame(rows, "k string, x double, y double")).collect()
    for k in "ab":
        x, y = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        want = {}
        for p in evaluation.LEVELS:
            c = np.percentile(x, p)
            high, low = y[x > c], y[x <= c]
            if min(len(high), len(low)) < 20:
                continue
            se = high.var(ddof=1) / len(high), low.var(ddof=1) / len(low)
            want[p] = (c, len(high), (high.mean() - low.mean()) / math.sqrt(sum(se)), sum(se) ** 2 / (se[0] ** 2 / (len(high) - 1) + se[1] ** 2 / (len(low) - 1)))
        own = {r.p: r for r in got if r.k == k}
        assert set(own) == set(want)
        for p, (c, n, t, df) in want.items():
            r = own[p]
            assert (r.threshold, r.high_n, r.t, r.t_df) == pytest.approx((c, n, t, df)) and r.exit_level == pytest.approx(c / 2)
        for sign, flag in ((1, "best_above"), (-1, "best_below")):
            side = [r for r in own.values() if r.t * sign > 0]
            assert [r.p for r in side if r[flag]] == ([min(side, key=lambda r: (round(r.t_p, 12), r.p)).p] if side else [])


def test_resampled_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(1, 10, 4), (2, 300, 260), (3, 0, 5), (4, 7, 0), (5, 4000, 3900), (6, 60, 61)]
    for share in (0.05, 0.5):
        for got in both(spark, lambda d, r: tails.resampled_quantile(d, r, "i", share), rows, "i int, tp int, fp int"):
            assert len(got) == len(rows)
            for r in got:
                _, a, b = rows[r["i"] - 1]
                drawn = rng.poisson(a, 400_000) - rng.poisson(b, 400_000)
                assert np.mean(drawn <= r["low"]) >= share - 0.004 and np.mean(drawn < r["low"]) < share + 0.004
