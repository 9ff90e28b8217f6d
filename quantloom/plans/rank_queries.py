"""Queries of percentiles against all history: ranks by chunks and buckets in Spark, by lists in the checking engine."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..frames import DUCK, SPARK, Dialect, Series, output, spark_sql, staged
from ..operators import bars as B
from ..operators import chains as A
from ..operators import flow as O
from ..operators.ranks import expanding_ranks
from . import views
from .registry import native, relation

LEAST_HISTORY = 10


def ranked_query(name: str, source: Callable[[Dialect], str], values: Mapping[str, Sequence[str]], build: Callable[[Dialect, str], str], order: str = "ts") -> None:
    """Register a query over rows with n_x, le_x and lt_x, the expanding ranks of each column x of `values`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = relation(spark, sf_dir, source(SPARK))
        for x, kinds in values.items():
            rows = expanding_ranks(rows, ["symbol"], [order], x, kinds).withColumnsRenamed({c: f"{c}_{x}" for c in ("n", *kinds)})
        return spark_sql(spark, build(SPARK, "{rows}"), rows=rows)

    over = Series(DUCK, order=(order,)).U
    count = lambda x, sign: f"case when {x} is not null then len(list_filter(list({x}) {over}, lambda v: v {sign} {x})) end"
    columns = {f"n_{x}": f"case when {x} is not null then count({x}) {over} end" for x in values} | {f"{k}_{x}": count(x, "<=" if k == "le" else "<") for x, kinds in values.items() for k in kinds}
    native(name, run, build(DUCK, staged(source(DUCK), columns)))


def against_history(x: str) -> str:
    """Percentile of a value among those before it, in which values equal to it count half."""
    return f"case when n_{x} > {LEAST_HISTORY} then (lt_{x} + le_{x} - 1 + case when le_{x} - 1 > lt_{x} then 1 else 0 end) * 50.0 / (n_{x} - 1) else 50.0 end"


def z_against_history(s: Series, x: str) -> str:
    dev = f"stddev_pop({x}) {s.B}"
    return f"case when n_{x} > {LEAST_HISTORY} and {dev} > 1e-12 then ({x} - avg({x}) {s.B}) / {dev} else 0.0 end"


ranked_query(
    "o07_vpin_cdf",
    lambda d: f"(select symbol, bucket, round(vpin, 9) as vpin from {O.vpin_buckets(Series(d), views.bars(d), 2000.0)} v)",
    {"vpin": ("le",)},
    lambda d, rows: output(staged(rows, {"vpin_cdf": "cast(le_vpin as double) / n_vpin"}), ("symbol", "bucket"), ["vpin_cdf"], [], 6),
    order="bucket",
)
#: From which percentile of volatility on each of the five levels begins.
VOL_LEVELS = ((80, "HIGH_VOL"), (60, "ELEVATED"), (40, "NORMAL"), (20, "LOW"), (0, "COMPRESSED"))
ranked_query(
    "b31_volatility_report",
    lambda d: f"(select symbol, ts, round(vol, 9) as vol from {B.rolling_vol(Series(d), views.bars(d))} v)",
    {"vol": ("lt",)},
    lambda d, rows: output(staged(rows, {"percentile": "100.0 * lt_vol / n_vol"}, {"label": "case " + " ".join(f"when percentile >= {p} then '{x}'" for p, x in VOL_LEVELS) + " end"}), ("symbol", "ts"), ["vol", "percentile"], ["label"], 4),
)


def nope_and_exposure(d: Dialect) -> str:
    chain = views.chain(d)
    return f"(select n.symbol, n.ts, round(n.nope, 9) as nope, round(g.net_gex, 3) as gex from {A.nope(chain)} n join {A.exposure_totals(chain)} g on n.symbol = g.symbol and n.ts = g.ts)"


#: Percentiles beyond which a flow is extreme, and beyond which exposure makes a regime.
EXTREME, REGIME = 90, 75


def flow_signals(d: Dialect, rows: str) -> str:
    s = Series(d)
    columns = {f"{x}_percentile": against_history(x) for x in ("nope", "gex")} | {f"{x}_z": z_against_history(s, x) for x in ("nope", "gex")}
    none = lambda x: f"when n_{x} <= {LEAST_HISTORY} or n_{x} is null then 'INSUFFICIENT_DATA'"
    signals = {
        "signal": f"case {none('nope')} when nope_percentile > {EXTREME} then 'BEARISH' when nope_percentile < {100 - EXTREME} then 'BULLISH' else 'NEUTRAL' end",
        "gamma_regime": f"case {none('gex')} when gex_percentile > {REGIME} then 'STRONG_LONG_GAMMA' when gex_percentile < {100 - REGIME} then 'SHORT_GAMMA' else 'NEUTRAL_GAMMA' end",
    }
    return output(staged(rows, columns, signals), ("symbol", "ts"), ["nope", "nope_percentile", "nope_z", "gex_percentile", "gex_z"], ["signal", "gamma_regime"], 4)


ranked_query("o22_nope_signal", nope_and_exposure, {"nope": ("le", "lt"), "gex": ("le", "lt")}, flow_signals)
