"""Recursions, change points and information measures against plain loops written apart from them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.frames import SPARK, Series, apply, spark_sql
from quantloom.operators import evaluation, factors, information, plugins, recursions, regimes, spectra


@pytest.fixture(scope="module")
def series(spark):
    """Two series whose mean and deviation change half way, in more batches than one."""
    rng = np.random.default_rng(4)
    rows = []
    for key, n in (("a", 150), ("b", 90)):
        x = np.concatenate([rng.normal(0, 1, n // 2), rng.normal(3, 2, n - n // 2)])
        rows += [(key, i, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts long, r double").repartition(5).cache()


def by_key(df, column, key="symbol"):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r[key], r.ts)):
        out.setdefault(r[key], []).append(r[column])
    return {k: np.array([np.nan if v is None else v for v in x], float) for k, x in out.items()}


@pytest.fixture(scope="module")
def values(series):
    return by_key(series, "r")


@pytest.fixture(autouse=True)
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_means(series, values):
    got = by_key(recursions.scan(series, ("symbol",), ("ts",), lambda: recursions.Means({"m": (lambda c: c["r"], 9)}), "m double"), "m")
    for k, x in values.items():
        want = [sum(x[j] * 0.8 ** (i - j) for j in range(i + 1)) / sum(0.8 ** (i - j) for j in range(i + 1)) for i in range(len(x))]
        np.testing.assert_allclose(got[k], want, rtol=1e-9)


def test_variance(series, values):
    rows = spark_sql(series.sparkSession, "select *, var_pop(r) over (partition by symbol) as v from {s}", s=series)
    got = by_key(recursions.scan(rows, ("symbol",), ("ts",), recursions.Variance, "h double, eta double"), "h")
    for k, x in values.items():
        v = x.var()
        want = [v]
        for t in range(1, len(x)):
            want.append(v * 0.05 + 0.05 * x[t - 1] ** 2 + 0.9 * want[-1])
        np.testing.assert_allclose(got[k], want, rtol=1e-9)


def test_correlation(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=80), rng.normal(size=80)
    rho = float(np.corrcoef(x, y)[0, 1])
    df = spark.createDataFrame([("p", i, float(a), float(b), rho) for i, (a, b) in enumerate(zip(x, y))], "symbol string, ts long, x double, y double, rho double")
    got = by_key(recursions.scan(df, ("symbol",), ("ts",), recursions.Correlation, "dcc double"), "dcc")["p"]
    start = np.array([[1, rho], [rho, 1]])
    q, want = start.copy(), [rho]
    for t in range(1, 80):
        e = np.array([x[t - 1], y[t - 1]])
        q = 0.04 * start + 0.01 * np.outer(e, e) + 0.95 * q
        want.append(q[0, 1] / math.sqrt(q[0, 0] * q[1, 1]))
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_run_lengths(series, values):
    """The posterior by a plain recursion over all run lengths."""
    rows = series.withColumn("x", F.col("r"))
    got = by_key(recursions.scan(rows, ("symbol",), ("ts",), recursions.RunLengths, "change double, run_length double, mean double"), "change")

    def density(x, n, total, square):
        mean = total / n if n else 0.0
        kappa, alpha = 1 + n, 1 + n / 2
        beta = 1 + 0.5 * (square - n * mean * mean) + n * mean * mean / (2 * kappa)
        mu, df, scale = total / kappa, 2 * alpha, math.sqrt(beta * (kappa + 1) / (alpha * kappa))
        return math.gamma((df + 1) / 2) / math.gamma(df / 2) / math.sqrt(df * math.pi) / scale * (1 + ((x - mu) / scale) ** 2 / df) ** (-(df + 1) / 2)

    x = values["b"]
    p, want = [1.0], []
    for t, v in enumerate(x):
        reach = []
        for r, w in enumerate(p):  # a run of length r holds the r + 1 rows before, one of length 0 only the prior
            past = x[max(0, t - r - 1) : t] if r else x[:0]
            reach.append(w * density(v, len(past), past.sum(), (past**2).sum()))
        want.append(0.01 * sum(reach))
        p = [want[-1], *(0.99 * w for w in reach)]
        p = [w / sum(p) for w in p]
    np.testing.assert_allclose(got["b"], want, rtol=1e-6)


def test_segments(series, values):
    """Against the best of all divisions, by dynamic programming without pruning."""
    rows = series.withColumns({"x": F.col("r"), "penalty": F.lit(9.0)})
    got = recursions.scan(rows, ("symbol",), ("ts",), recursions.Segments, "segment_start double, segments double")
    for k, x in values.items():
        best, cut, count = [0.0] + [math.inf] * len(x), [0] * (len(x) + 1), [0] * (len(x) + 1)
        for t in range(5, len(x) + 1):
            for s in range(t - 4):
                part = x[s:t]
                cost = best[s] + len(part) / 2 * (math.log(2 * math.pi) + math.log(max(part.var(), 1e-10)) + 1) + 9.0
                if cost < best[t] - 1e-9:
                    best[t], cut[t], count[t] = cost, s, count[s] + 1
        np.testing.assert_array_equal(by_key(got, "segment_start")[k][10:], cut[11:])
        assert by_key(got, "segments")[k][-1] == count[-1] > 1


def test_hidden_states(spark):
    rng = np.random.default_rng(9)
    state, rows, truth = 0, [], {}
    for key in ("a", "b", "c"):
        for i in range(700):
            state = 1 - state if rng.random() < 0.02 else state
            rows.append((key, i, float(rng.normal(0.05 if not state else -0.1, 0.3 if not state else 1.5))))
            truth[key, i] = state
    df = spark.createDataFrame(rows, "symbol string, ts long, r double")
    out, params = recursions.pooled_states(df, ("symbol",), ("ts",), piece=256)
    assert abs(params["dev"][0] - 0.3) < 0.05 and abs(params["dev"][1] - 1.5) < 0.15 and min(params["stay"]) > 0.95
    got = out.collect()
    assert len(got) == 2100 and np.mean([(r.p1 > 0.5) == truth[r.symbol, r.ts] for r in got]) > 0.93
    assert all(abs(r.p0 + r.p1 - 1) < 1e-9 for r in got)


def test_cusum(series, values):
    got = apply(regimes.cusum_mean, series, drift=0.25)
    up, down, alarm = (by_key(got, c) for c in ("cusum_up", "cusum_down", "alarm"))
    for k, x in values.items():
        ref = x[: max(20, len(x) // 5)]
        z = (x - ref.mean()) / ref.std(ddof=1)
        a, b, over = [0.0], [0.0], [0]
        for t in range(1, len(x)):
            a.append(max(0, a[-1] + z[t] - 0.25)), b.append(min(0, b[-1] + z[t] + 0.25))
            over.append(int(max(a[-1], -b[-1]) > 5))
        np.testing.assert_allclose(up[k], a, atol=1e-9)
        np.testing.assert_allclose(down[k], b, atol=1e-9)
        np.testing.assert_array_equal(alarm[k], [int(o and not p) for o, p in zip(over, [0, *over])])


def test_entropy_and_divergence(series, values):
    entropy = by_key(apply(information.rolling_entropy, series, window=30, bins=8), "entropy")
    kl = by_key(apply(information.rolling_divergence, series, baseline=40, current=12, bins=6), "kl")
    for k, x in values.items():
        for t in range(29, len(x)):
            h = np.histogram(x[t - 29 : t + 1], 8)[0]
            h = h[h > 0] / 30
            assert entropy[k][t] == pytest.approx(-(h * np.log2(h)).sum(), abs=1e-9)
        assert np.isnan(entropy[k][:29]).all()
        for t in range(51, len(x)):
            edges = np.histogram(x[t - 51 : t + 1], 6)[1]
            p, q = np.histogram(x[t - 11 : t + 1], edges)[0] / 12, np.histogram(x[t - 51 : t - 11], edges)[0] + 1e-10
            q = q / q.sum()
            assert kl[k][t] == pytest.approx(max(0, sum(a * math.log(a / b) for a, b in zip(p, q) if a > 0)), rel=1e-6)


def test_granger(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.3 * y[t - 1] + 0.7 * x[t - 1] + rng.normal()
    rows = [("y", "x", t, float(y[t]), float(x[t])) for t in range(400)] + [("x", "y", t, float(x[t]), float(y[t])) for t in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, ts long, ra double, rb double")
    got = {r.a: r.f for r in spark_sql(spark, f"select * from {information.granger('{pairs}', Series(SPARK, ('a', 'b')))} g", pairs=df).collect()}

    def f_of(effect, cause, lags=5):
        past = lambda v: np.column_stack([v[lags - k - 1 : len(v) - k - 1] for k in range(lags)])
        target, one = effect[lags:], np.ones((len(effect) - lags, 1))
        rss = lambda m: ((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2).sum()
        own, both = rss(np.hstack([one, past(effect)])), rss(np.hstack([one, past(effect), past(cause)]))
        return (own - both) / lags / (both / (len(target) - 2 * lags - 1))

    assert got["y"] == pytest.approx(f_of(y, x), rel=1e-6) and got["x"] == pytest.approx(f_of(x, y), rel=1e-6)
    assert got["y"] > 20 > got["x"]


def test_spectrum_measures():
    rng = np.random.default_rng(6)
    cov = np.stack([np.cov(rng.normal(size=(4, 60))) for _ in range(5)])
    for c in cov:
        ratio, h = spectra.absorption(np.linalg.eigvalsh(c), 0.8), spectra.entropy(np.linalg.eigvalsh(c))
        v = np.sort(np.linalg.eigvalsh(c))[::-1]
        n = next(k for k in range(1, 5) if v[:k].sum() >= 0.8 * v.sum())
        p = v / v.sum()
        assert ratio == pytest.approx(v[:n].sum() / v.sum()) and h == pytest.approx(-(p * np.log(p)).sum() / math.log(4))


def test_ranks_from_whole_numbers(spark):
    """A rank that is a multiple of a ninth falls in its bin."""
    df = spark.createDataFrame([("a", i, float(i)) for i in range(9)], "symbol string, ts long, x double")
    s = Series(SPARK)
    got = [r.b for r in spark_sql(spark, f"select ts, floor({s.twice_rank('x', 9)} * 9 / cast(18 as double)) as b from {{d}} order by ts", d=df).collect()]
    assert got[-1] == 9 and got[:-1] == [None] * 8


def test_formulas():
    assert factors.formula("sqrt(x0) / x1 - 2", {"x0": "a", "x1": "b"}) == "((sqrt(greatest(a, 0)) / nullif(b, 0)) - cast(2 as double))"
    for bad in ("__import__('os')", "x0.y", "y0 + 1", "open(x0)", "x0 if x1 else 2", "[x0]", "x0 ** 2"):
        with pytest.raises((ValueError, SyntaxError)):
            factors.formula(bad, {"x0": "a", "x1": "b"})


def test_plugins(spark):
    reg = plugins.Registry()

    @reg.analysis("n", requires=("a",))
    def n(df, params):
        return df.groupBy().count()

    df = spark.range(3).withColumnRenamed("id", "a")
    assert reg.run("n", df).first()[0] == 3 and reg.names() == ["n"]
    with pytest.raises(ValueError, match="needs"):
        reg.run("n", df.withColumnRenamed("a", "b"))


def test_legs():
    import duckdb

    rows = duckdb.sql(f"select structure, count(*), sum(qty) from {evaluation.build_legs('(select 1 as symbol, 2 as ts, 100.0 as spot)')} l group by structure").fetchall()
    assert {r[0]: r[1:] for r in rows}["iron_condor"] == (4, 0) and len(rows) == len(evaluation.STRUCTURES)
