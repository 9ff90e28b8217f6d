"""Expanding ranks against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators.ranks import earlier_smaller, expanding_ranks


def test_earlier_smaller():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 8, 9, 100, 257):
        rank = rng.permutation(n)
        assert earlier_smaller(rank).tolist() == [sum(rank[j] < rank[i] for j in range(i)) for i in range(n)]


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and r[2] is not None), key=lambda r: r[1])
        x = np.array([r[2] for r in own])
        for i, r in enumerate(own):
            out[r[:2]] = (i + 1, int((x[: i + 1] <= x[i]).sum()), int((x[: i + 1] < x[i]).sum()))
    return out


@pytest.mark.parametrize("block", [1, 64, 1000, 1 << 15])
def test_expanding_ranks(spark, block):
    rng = np.random.default_rng(block)
    n = 10_000 if block >= 64 else 300
    # one key holds nearly all rows; a third of them share one value
    rows = [("hot", int(t), 0.5 if rng.random() < 0.33 else round(float(rng.normal(0, 1)), 2)) for t in rng.permutation(n)]
    rows += [("small", t, float(t % 3)) for t in range(20)] + [(None, t, 1.0) for t in range(5)] + [("hot", n + 1, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "symbol string, ts long, x double").withColumn("other", F.lit("kept"))
    got = expanding_ranks(df, ["symbol"], ["ts"], "x", ("le", "lt"), block).collect()
    want = brute(rows)
    assert len(got) == len(rows) and {r.other for r in got} == {"kept"}
    for r in got:
        assert (r.n, r.le, r.lt) == want.get((r.symbol, r.ts), (None, None, None))


def test_nothing(spark):
    assert expanding_ranks(spark.createDataFrame([], "symbol string, ts long, x double"), ["symbol"], ["ts"], "x").count() == 0
