"""Greedy clusters against the loop they stand for, and clusters that were planted."""

import collections

import numpy as np
import pytest

from quantloom.operators import clusters


def by_loop(items, links, least):
    near = collections.defaultdict(set)
    for a, b in links:
        near[a].add(b), near[b].add(a)
    taken = {}
    for i in sorted(items):
        if i in taken:
            continue
        group = {i} | {j for j in near[i] if j not in taken}
        if sum(items[j] for j in group) >= least:
            taken |= {j: i for j in group}
    return taken


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_greedy_clusters(spark, kind):
    rng = np.random.default_rng(len(kind))
    items = {int(i): int(rng.integers(1, 3)) if kind == "random" else 1 for i in rng.permutation(60)}
    links = {"random": {tuple(sorted(rng.choice(60, 2, replace=False).tolist())) for _ in range(70)}, "path": {(i, i + 1) for i in range(25)}, "star": {(0, i) for i in range(1, 40)} | {(i, i + 1) for i in range(41, 50)}, "none": set()}[kind]
    got = clusters.greedy_clusters(spark.createDataFrame(list(items.items()), "id long, n int"), spark.createDataFrame(list(links), "x long, y long"), 3).collect()
    assert {r.id: r.cluster for r in got} == by_loop(items, links, 3) and all(r.weight == items[r.id] for r in got)


def test_planted_clusters(spark):
    rng = np.random.default_rng(7)
    rows = [(g, *map(float, rng.normal((g + 1, 5 * (g % 2), -3 * g), 0.15))) for g in range(4) for _ in range(80)]
    df = clusters.scaled(spark.createDataFrame(rows, "planted int, volatility double, trend double, volume_ratio double"), ["volatility", "trend", "volume_ratio"])
    got = clusters.clustered(df).collect()
    assert all(r.cluster == r.planted for r in got)  # numbered by volatility
    votes = clusters.voted(df).collect()
    assert np.mean([r.regime == r.planted for r in votes]) > 0.98
    assert all(r.confidence == pytest.approx(sum(x == r.regime for x in (r["first"], r["second"], r["mixture"])) / 3, abs=1e-6) for r in votes)
