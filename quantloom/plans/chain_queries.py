"""Queries over option chains, joins, cleaning, evaluation, reports and recall."""

from __future__ import annotations

from ..frames import Series, output, staged
from ..operators import bars as B
from ..operators import chains as A
from ..operators import flow as O
from ..operators import regimes as G
from . import views
from .flow_queries import labelled, vixed
from .registry import query, stored_query

DAY = ("symbol", "ts")


def _chain(name, sql, keys, rounded, plain=(), digits=5) -> None:
    query(name, lambda d: output(sql(d, views.chain(d)), keys, rounded, plain, digits))


_chain("m01_greeks", lambda d, c: A.greeks(c), ("symbol", "ts", "strike", "dte", "opt"), ["price", "delta", "gamma", "vega", "theta", "vanna", "charm"], digits=7)
query("m02_normal", lambda d: f"select symbol, ts, round(cast({O.normal_cdf('z')} as double), 7) as cdf, round({O.normal_pdf('z')}, 7) as pdf from (select symbol, ts, (close - open) / close as z from {views.bars(d)} b) x")
_chain("a07_exposure_by_strike", lambda d, c: A.exposure_by_strike(c), ("symbol", "ts", "strike"), ["gex", "call_gex", "put_gex", "vex", "cex"], digits=4)
_chain("a08_exposure_totals", lambda d, c: A.exposure_totals(c), DAY, ["net_gex", "call_gex", "put_gex", "net_vex", "net_cex"], ["position"], 3)
_chain("a09_walls", lambda d, c: A.walls(d, c), DAY, ["call_wall", "put_wall"])
_chain("a10_zero_gamma", lambda d, c: A.zero_gamma(c), DAY, ["zero_gamma"], digits=4)
_chain("a11_gamma_flip", lambda d, c: A.gamma_flip(c), DAY, ["flip_strike"])
_chain("a12_nope", lambda d, c: A.nope(c), DAY, ["call_flow", "put_flow", "nope"])
_chain("a13_gamma_shape", lambda d, c: A.gamma_shape(d, c), DAY, ["concentration", "skew_side", "peak_strike"])
_chain("a14_vol_surface", lambda d, c: A.vol_surface(c), ("symbol", "ts", "dte"), ["atm", "down", "up", "skew", "butterfly", "term_slope"], digits=7)
_chain("a15_chain_features", lambda d, c: A.chain_features(d, c), DAY, ["put_call", "straddle", "implied", "term_ratio"])
_chain("a32_wall_table", lambda d, c: A.wall_table(c), ("symbol", "ts", "kind", "rank_"), ["strike", "strength", "distance"])
_chain("o23_pinning", lambda d, c: f"(select symbol, ts, strike, greatest(0, 1 - abs(strike / spot - 1) / 0.05) * cast(sum(oi) as double) / sum(sum(oi)) over (partition by symbol, ts) * least(1, 7.0 / min(dte)) as pin from {c} c group by symbol, ts, spot, strike)", ("symbol", "ts", "strike"), ["pin"])
_chain("g08_put_call", lambda d, c: staged(A.chain_features(d, c), {"velocity": f"put_call - {Series(d).lag('put_call')}", "flag": "case when put_call > 1.2 then 1 when put_call < 0.7 then -1 else 0 end"}), DAY, ["put_call", "velocity"], ["flag"])
_chain("g35_exposure_dynamics", lambda d, c: staged(A.exposure_totals(c), {"velocity": f"net_gex - {Series(d).lag('net_gex')}"}, {"acceleration": f"velocity - {Series(d).lag('velocity')}"}), DAY, ["velocity", "acceleration"], digits=3)
_chain("t11_flip_events", lambda d, c: f"(select * from {staged(A.exposure_totals(c), {'side': "case when net_vex >= 0 then 'LONG' else 'SHORT' end"}, {'was': Series(d).lag('side')})} x where side <> was)", DAY, ["net_vex"], ["was", "side"], 3)
_chain("i13_gamma_series", lambda d, c: staged(A.exposure_totals(c), {"mean_20": Series(d).roll("avg", "net_gex", 20), "dev_20": Series(d).roll("stddev_samp", "net_gex", 20)}, {"position_z": "(net_gex - mean_20) / greatest(dev_20, 1e-10)"}), DAY, ["mean_20", "position_z"], digits=4)
_chain("e40_structure_payoffs", lambda d, c: A.structure_returns(d, c), ("symbol", "ts", "dte", "structure"), ["r"], digits=6)
stored_query(
    "e41_surface_stats",
    lambda d: f"(select symbol, ts, dte, structure, round(r, 9) as r from {A.structure_returns(d, views.chain(d))} x)",
    lambda d, rows: output(A.surface_stats(rows, d), ("structure", "dte"), ["mean", "ann_return", "ann_vol", "sharpe", "win_rate", "max_drawdown", "skewness", "kurtosis"], ["n", "rank_"], 4),
)
_chain("c02_with_dte", lambda d, c: f"(select symbol, ts, dte, {d.days(d.plus_days('ts', 'dte'), 'ts')} as days_left, count(*) as n from {c} c group by symbol, ts, dte)", ("symbol", "ts", "dte"), [], ["days_left", "n"])


def quoted(d, c: str) -> str:
    """Contracts with the quotes of a modelled spread around their price, wider in the wings and with time."""
    priced = d.fence(A.greeks(c), *CONTRACT, "spot", "opt_volume", "price")
    spread = staged(priced, {"half": "greatest(0.01, price * (0.02 + 0.9 * abs(strike / spot - 1) + 0.0008 * dte)) / 2"})
    return staged(spread, {"bid": "price - half", "ask": "price + half"})


GOOD = "price > 0 and bid > 0 and ask > 0 and ask >= bid and opt_volume > 0"
CONTRACT = ("symbol", "ts", "dte", "opt", "strike")
_chain("c03_filter_bad_quotes", lambda d, c: f"(select * from {quoted(d, c)} q where {GOOD} and not ((bid + ask) / 2 > 0.50 and (ask - bid) / ((bid + ask) / 2) > 0.20))", CONTRACT, ["price", "bid", "ask"])
_chain("c04_filter_garbage", lambda d, c: f"(select * from {quoted(d, c)} q where {GOOD})", CONTRACT, ["price", "bid", "ask"])
_chain("c06_spread_model", lambda d, c: f"(select symbol, ts, dte, opt, strike, greatest(0.01, 0.05 * (1 + 2 * abs(strike / spot - 1)) * case when dte <= 7 then 1.5 when dte <= 30 then 1.2 else 1 end * (1 + iv)) as spread from {c} c)", ("symbol", "ts", "dte", "opt", "strike"), ["spread"])
_chain("c08_chain_filter", lambda d, c: f"(select * from {c} c where dte between 14 and 60 and abs(strike / spot - 1) <= 0.1)", ("symbol", "ts", "dte", "opt", "strike"), [], ["oi", "opt_volume"])
