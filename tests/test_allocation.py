"""Exit sweeps and weight searches against loops."""

import itertools

import numpy as np
import pytest

from quantloom.frames import SPARK, spark_sql
from quantloom.operators import allocation


def test_exit_sweep(spark):
    rng = np.random.default_rng(1)
    paths = {i: np.cumsum(rng.normal(20, 120, rng.integers(1, 25))).round(2).tolist() for i in range(60)}
    paths[100] = [150.0, 50.0, 900.0]  # armed on the first day, stopped on the next
    rows = [(i, k + 1, p) for i, path in paths.items() for k, p in enumerate(path)]
    got = {r.rule: r for r in spark_sql(spark, f"select * from {allocation.exit_sweep(SPARK, '{p}')} x", p=spark.createDataFrame(rows, "trade_id int, day int, pnl double")).collect()}

    def stats(leave):
        out = []
        for path in paths.values():
            k = leave(path)
            out.append((path[k], max(path[: k + 1]), k + 1))
        pnl, peak = sum(x[0] for x in out), sum(x[1] for x in out)
        return pnl, 100 * np.mean([x[0] > 0 for x in out]), np.mean([x[2] for x in out]), 100 * pnl / peak if peak > 0 else 0, np.mean([100 * x[0] / x[1] for x in out if x[1] != 0])

    def trailing(level, trail):
        def leave(path):
            armed, top = False, -np.inf
            for k, p in enumerate(path):
                armed |= p >= level
                if armed:
                    top = max(top, p)
                    if p <= top - trail:
                        return k
            return len(path) - 1

        return leave

    held = lambda h: lambda path: min(h, len(path) - 1)
    base = stats(held(14))
    rules = {f"day_{h}": held(h) for h in (2, 3, 5, 7, 10, 14)} | {f"trail_{k}_{t}": trailing(k, t) for k in (150, 300, 500) for t in (100, 200, 300)}
    assert set(got) == set(rules)
    for name, leave in rules.items():
        r, want = got[name], stats(leave)
        assert (r.total_pnl, r.win_rate, r.avg_days, r.capture_rate, r.avg_peak_pct) == pytest.approx(want)
        assert (r.delta_pnl, r.delta_win_rate) == pytest.approx((want[0] - base[0], want[1] - base[1]), abs=1e-9)


def test_weight_search(spark):
    rng = np.random.default_rng(2)
    assets = ["a", "b", "c"]
    rows = [(t, "calm" if t % 3 else "wild", *rng.normal(0.001, 0.02, 3).round(5).tolist()) for t in range(150)] + [(999, "rare", 0.0, 0.0, 0.0)]
    got = {(r.regime, r.objective): r for r in spark_sql(spark, f"select * from {allocation.weight_search(SPARK, '{w}', assets)} x", w=spark.createDataFrame(rows, "ts int, regime string, a double, b double, c double")).collect()}
    grid = [w for w in itertools.product(range(4), repeat=3) if sum(w) == 5]
    assert {k[0] for k in got} == {"calm", "wild"} and len(got) == 8
    for regime in ("calm", "wild"):
        x = np.array([r[2:] for r in rows if r[1] == regime])
        best = {}
        for w in grid:
            r = x @ np.array(w) / 5
            wealth = np.cumprod(1 + r)
            peak = np.maximum.accumulate(wealth)
            for name, v in (("sharpe", r.mean() * 252 / (r.std(ddof=1) * 252**0.5)), ("sortino", r.mean() * 252 / (np.sqrt(np.mean(np.minimum(r, 0) ** 2)) * 252**0.5)), ("max_return", r.mean() * 252), ("min_drawdown", ((wealth - peak) / peak).min())):
                if name not in best or v > best[name][0]:
                    best[name] = (v, w)
        for name, (v, w) in best.items():
            r = got[regime, name]
            assert r.value == pytest.approx(v, abs=1e-8) and [r.w0 * 5, r.w1 * 5, r.w2 * 5] == pytest.approx(list(w))


def test_surface_stats(spark):
    """Statistics of structures against pandas."""
    import pandas as pd

    from quantloom.operators import chains

    rng = np.random.default_rng(3)
    rows = [(s, t, d, k, float(rng.normal(0.01, 0.2).__round__(6))) for s in "ab" for t in range(40) for d in (7, 30) for k in ("straddle", "call_ATM") if rng.random() < 0.9]
    rows += [("a", t, 7, "rare", 0.1) for t in range(19)] + [("a", 0, 60, "call_ATM", None)]
    got = {(r.structure, r.dte): r for r in spark_sql(spark, f"select * from {chains.surface_stats('{r}')} x", r=spark.createDataFrame(rows, "symbol string, ts int, dte int, structure string, r double")).collect()}
    frame = pd.DataFrame(rows, columns=["symbol", "ts", "dte", "structure", "r"]).dropna()
    daily = frame.groupby(["structure", "dte", "ts"]).r.mean()
    assert set(got) == {(s, d) for s in ("straddle", "call_ATM") for d in (7, 30)}
    sharpes = {}
    for key, r in got.items():
        x = daily[key]
        wealth = (1 + x).cumprod()
        year = wealth.iloc[-1] ** (252 / len(x)) - 1
        sharpes[key] = year / (x.std() * 252**0.5)
        want = (len(x), x.mean(), year, x.std() * 252**0.5, sharpes[key], (x > 0).mean(), (wealth / wealth.cummax() - 1).min(), x.skew(), x.kurt())
        assert (r.n, r.mean, r.ann_return, r.ann_vol, r.sharpe, r.win_rate, r.max_drawdown, r.skewness, r.kurtosis) == pytest.approx(want)
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1].rank_)] == sorted(sharpes, key=lambda k: -sharpes[k])
