"""Spectra against pandas' pairwise correlations, with instruments that miss days."""

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import spectra


@pytest.fixture(scope="module")
def returns():
    rng = np.random.default_rng(3)
    common = rng.normal(0, 1, 150)
    rows = []
    for k in range(7):
        for day in range(150):
            if k == 6 and day < 100 or rng.random() < 0.15 or (k == 5 and day % 3):
                continue  # a late comer, a rare trader, and gaps everywhere
            rows.append((f"s{k}", day * 2, float(0.1 * common[day] * (k + 1) + rng.normal(0, 1))))
    return rows


@pytest.mark.parametrize(("tile", "span"), [(32, 256), (2, 50), (3, 20)])
def test_pairwise_complete_days(spark, returns, tile, span):
    window, least = 20, 8
    df = spark.createDataFrame([*returns, ("s0", None, 1.0), (None, 3, 1.0), ("s1", 4, None)], "symbol string, ts int, r double")
    got = {r.ts: r for r in spectra.correlation_spectra(df, window, least, 0.8, tile, span).collect()}
    wide = pd.DataFrame(returns, columns=["symbol", "ts", "r"]).pivot(index="ts", columns="symbol", values="r")
    checked = 0
    for i, ts in enumerate(wide.index):
        part = wide.iloc[max(i - window, 0) : i]
        own = part.columns[part.notna().sum() >= least]
        if i < window or len(own) < 2:
            assert ts not in got
            continue
        corr = part[own].corr(min_periods=least).fillna(0).to_numpy(copy=True)
        cov = part[own].cov(min_periods=least).fillna(0).to_numpy()
        off = corr[~np.eye(len(own), dtype=bool)]
        values = np.maximum(np.sort(np.linalg.eigvalsh(corr))[::-1], 0)
        share, k = np.cumsum(values) / values.sum(), 0
        while share[k] < 0.8:
            k += 1
        positive = np.linalg.eigvalsh(cov)
        p = positive[positive > 1e-10 * positive.max()]
        p = p / p.sum()
        want = [share[k], -(p * np.log(p)).sum() / np.log(len(p)), off.mean(), np.abs(off).max(), off.std()]
        assert [got[ts][c] for c in spectra.MEASURES] == pytest.approx(want, rel=1e-7, abs=1e-9) and got[ts].instruments == len(own)
        checked += 1
    assert checked == len(got) > 120 and {r.instruments for r in got.values()} == {5, 6}


def test_nothing(spark):
    assert spectra.correlation_spectra(spark.createDataFrame([], "symbol string, ts int, r double")).count() == 0
