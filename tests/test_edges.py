"""Odd inputs against the queries' SQL: prices of zero, structures that are alike."""

import datetime
import types

import duckdb
import numpy as np
import pandas as pd
import pytest

from quantloom import plans
from quantloom.frames import SPARK, spark_sql
from quantloom.operators import chains, contracts, evaluation, search
from quantloom.plans import lookup_queries as lookups
from quantloom.streaming import carried


def rows_and_sql(spark, path, name, **tables):
    """A query's rows over tables written to a folder, and those of its SQL; floats to nine digits."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    cell = lambda v: "~" if v is None or v is pd.NaT or v != v else f"{v:.9g}" if isinstance(v, (int, float)) else str(v)
    plain = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    return plain(plans.QUERIES[name](spark, str(path)).toPandas()), plain(con.execute(plans.ORACLES[name]).df())


def events(spark, rows):
    """rows: seconds, user, kind, value."""
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + datetime.timedelta(seconds=s), u, k, v, f'{{"k": {i % 7 + 1}}}') for i, (s, u, k, v) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


@pytest.mark.parametrize("name", ["a05_last_value_timeframes", "b29_timeframe_cascade"])
def test_prices_of_zero(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    rows = [(600 * i, 1, "view", 0.0 if rng.random() < 0.5 or i > 700 else float(rng.integers(1, 9))) for i in range(800)]
    got, want = rows_and_sql(spark, tmp_path, name, events=events(spark, rows))
    assert got == want and len(got) > 5 and any("inf" in r for r in got)


def test_equal_structures_have_equal_statistics(spark):
    """Those of the same returns in another order are ranked by name."""
    lost, won = [-0.999994955, -0.999993136, -0.999991901, -0.999998155, -0.999998745], 1e7
    rows = [(t, 7, f"{kind}_{bucket}", r) for t in range(25) for kind in "xy" for bucket in ("10D", "5D") for r in ([won] if t % 2 else lost if (kind, bucket) in (("x", "5D"), ("y", "10D")) else lost[::-1])]
    df = spark.createDataFrame(rows, "ts int, dte int, structure string, r double").coalesce(1)
    got = {r.structure: r for r in spark_sql(spark, f"select * from {chains.surface_stats('{r}')} x", r=df).collect()}
    assert len({r.sharpe for r in got.values()} - {None}) == 1 and sorted(got, key=lambda s: got[s].rank_) == sorted(got)


def test_upcoming_events_without_pairs(spark, tmp_path):
    """Events of one second, at the end of the reach, and in far bins; no row for a pair of a bar and an event."""
    rng = np.random.default_rng(5)
    rows = [(300 * i, i % 3, "view", 1.0 + i % 5) for i in range(900) if i % 7]
    rows += [(int(s), int(u), k, 2.0) for s in rng.integers(0, 40_000, 150).tolist() for u, k in ((rng.integers(0, 4), "error"), (1, "signup"))]
    rows += [(300 * 20 + 86_400, 1, "signup", 1.0), (300 * 30 + 86_401, 1, "error", 1.0), (230_000, 2, "error", 1.0), (230_000, 1, "error", 1.0)]
    got, want = rows_and_sql(spark, tmp_path, "c17_upcoming_minutes", events=events(spark, rows))
    assert got == want and 100 < len(got) < 771
    sql = lookups.V.upcoming(SPARK, lookups.minute_bars(SPARK), ("symbol",), lookups.calendar(SPARK), 24)
    assert "due_s +" not in sql and "b.ts_s >= s.due_s" not in sql


def test_quantiles_and_rules_are_exact(spark):
    """Ties, one value, missing values and a far value; counts of each rule against a loop."""
    rng = np.random.default_rng(8)
    values = {"a": [*rng.normal(size=301).tolist(), 1e12, None], "b": rng.integers(0, 6, 200).astype(float).tolist(), "c": [3.0] * 7, "d": [2.0, None], "e": [-1.0, 5.0]}
    rows = [(f, int(i % 3 == 0), v) for f, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "feature string, label int, value double").repartition(5)
    limits = {(r.feature, r.pct): r.threshold for r in spark_sql(spark, f"select * from {evaluation.sorted_quantiles('{r}', ('feature',), evaluation.PERCENTILES)} q", r=df).collect()}
    known = {f: np.array([v for v in vs if v is not None]) for f, vs in values.items()}
    assert limits == pytest.approx({(f, p): np.quantile(v, p / 100) for f, v in known.items() for p in evaluation.PERCENTILES}, rel=1e-14)
    got = spark_sql(spark, f"select * from {evaluation.confusion(SPARK, '{r}', evaluation.thresholds(SPARK, '{r}', ('feature',)), ('feature',))} c", r=df).collect()
    assert len(got) == 2 * len(limits)
    for r in got:
        hit = lambda v: v <= r.threshold if r.direction == "below" else v >= r.threshold  # noqa: B023, E731
        mine = [(hit(v), y) for f, y, v in rows if f == r.feature and v is not None]
        assert (r.tp, r.fp, r.fn, r.tn) == tuple(mine.count(x) for x in ((True, 1), (True, 0), (False, 1), (False, 0)))


@pytest.mark.parametrize("name", ["e32_rule_search", "e54_two_feature_rules"])
def test_trades_of_rules_are_read_once(spark, sf, name):
    """The plan reads written steps: no line items, and no percentile that one task holds."""
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "percentile(" not in plan


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("k", [1, 4])
def test_search_writes_no_pairs(spark, k):
    """Frequent words in all documents, in several rounds of queries: the plan joins no postings, and the best are those of a loop."""
    docs = [(i, f"the {'the ' * (i % 3)}w{i % 4} {'x ' * (i % 5)}", 1.0) for i in range(90)]
    index = search.build(spark.createDataFrame(docs, "doc long, text string, weight double").repartition(3))
    asked = search.query_terms(spark.createDataFrame([(i, f"the w{i % 4}") for i in range(30)], "q long, text string"), index)
    found = search.top_documents(asked, index, k)
    scores = search.pair_scores(spark.range(90).selectExpr("id as doc").crossJoin(spark.range(30).selectExpr("id as q")), asked, index).collect()
    want = {(r.q, r.doc, r.score) for q in range(30) for r in sorted((r for r in scores if r.q == q), key=lambda r: (-r.score, r.doc))[:k]}
    assert "Join" not in plan(found) and {(r.q, r.doc, r.score) for r in found.collect()} == want and len(scores) == 2700


def test_index_writes_no_pairs(spark):
    """What a query meets is compared where it is met: the same best as from the written candidates."""
    x = np.random.default_rng(1).normal(size=(300, 12))
    x[40:60] = x[0]  # equal ones
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    index = search.Hyperplanes(rows, 12, bits=6, tables=2)
    asked = spark.createDataFrame([(q,) for q in range(0, 300, 20)], "q long")
    met, unit = {(r.q, r.vec_id) for r in index.candidates(asked, 1).collect()}, x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, j) for q in range(0, 300, 20) for _, j in sorted((-round(float(unit[q] @ unit[j]), 6), j) for a, j in met if a == q)[:7]}
    found = index.nearest(asked, 7, 1)
    assert {(r.q, r.vec_id) for r in found.collect()} == want and plan(found).count("Join") == 0


class Held(dict):
    """The states and timers of a key, in memory."""

    def __init__(self):
        super().__init__()
        self.timers = []
        self.registerTimer = self.timers.append
        self.getValueState = lambda name, schema: types.SimpleNamespace(exists=lambda: name in self, get=lambda: self[name], update=lambda v: self.update({name: v}))
        self.getMapState = lambda name, schema, value: types.SimpleNamespace(keys=lambda: iter([k for k in self if isinstance(k, tuple)]), getValue=self.get, removeKey=self.pop, updateValue=self.__setitem__)


class Taken:
    """How many rows are taken at once."""

    def push(self, columns):
        n = len(columns["close"])
        return {"at_once": np.full(n, n)}


def test_waiting_rows_are_taken_by_bins():
    """Two days of a key in two batches, out of order; the watermark passes all but the last row, which waits."""
    columns = ["symbol", "ts", "event_id", "close"]
    key, held = carried._Carried(Taken, columns, ["ts", "event_id"], ["at_once"]), Held()
    key.init(held)
    rows = pd.DataFrame([("a", datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=30 * i), i, 1.0, False) for i in reversed(range(96))], columns=[*columns, "_mark"])
    list(key.handleInputRows(("a",), iter([rows[::2].copy(), rows[1::2].copy()]), None))
    passed = int(rows["ts"].max().timestamp() * 1000)
    out = pd.concat(list(key.handleExpiredTimer(("a",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: passed), None)))
    assert out["event_id"].tolist() == list(range(95)) and out["at_once"].max() == 12
    assert held.timers == [1704067200001, passed + 1] and sum(isinstance(k, tuple) for k in held) == 1


@pytest.mark.parametrize("look", [contracts.exact, contracts.nearest])
def test_wanted_contracts_are_read_once(look):
    assert look(SPARK, "wanted_rows", "chain_rows", ("price", "oi")).count("wanted_rows") == 1
