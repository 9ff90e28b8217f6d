"""Queries of order flow, regimes and durations."""

from __future__ import annotations

from ..frames import Series, output, staged
from ..operators import asof as P
from ..operators import bars as B
from ..operators import flow as O
from ..operators import regimes as G
from . import views
from .registry import query, stored_query

KEYS = ("symbol", "ts")


def _bars(name, op, rounded, plain=(), digits=5, source=views.bars, **params) -> None:
    query(name, lambda d: output(op(Series(d), source(d), **params), KEYS, rounded, plain, digits))


def _ticks(name, op, rounded, plain=(), digits=5, **params) -> None:
    def build(d):
        return output(op(Series(d, order=("ts", "event_id")), views.events_ticks(d), **params), (*KEYS, "event_id"), rounded, plain, digits)

    query(name, build)


def book(d):
    """Best quotes from the events: sizes from their properties."""
    return f"(select *, floor(price * 99) / 100 as bid, ceil(price * 101) / 100 as ask, size as bid_size, 100 - size as ask_size from {views.events_ticks(d)} e)"


_ticks("o01_tick_sign", O.tick_sign, [], ["tick_sign"])
_bars("o03_bulk_volume", O.bulk_volume, ["buy_share", "buy_volume", "sell_volume"])
query("o04_volume_buckets", lambda d: output(O.vpin_buckets(Series(d), views.bars(d), 2000.0), ("symbol", "bucket"), ["buy", "sell", "volume", "imbalance"], ["ts"], 5))
query("o05_vpin", lambda d: output(O.vpin_buckets(Series(d), views.bars(d), 2000.0), ("symbol", "bucket"), ["vpin"], ["ts"], 6))
query("o06_vpin_alert", lambda d: output(staged(f"(select symbol, bucket, round(vpin, 9) as vpin from {O.vpin_buckets(Series(d), views.bars(d), 500.0)} v)", {"vpin_rank": Series(d, order=("bucket",)).pct_rank("vpin", 252)}, {"alert": "case when vpin_rank > 0.9 then 1 else 0 end"}), ("symbol", "bucket"), ["vpin", "vpin_rank"], ["alert"]))
_bars("o08_price_impact", O.price_impact, ["impact", "fit", "impact_t"], ["n"])
_bars("o09_impact_ratio", O.impact_ratio, ["impact_ratio"], digits=8)
query("o10_order_flow_imbalance", lambda d: output(O.order_flow_imbalance(Series(d, order=("ts", "event_id")), book(d)), (*KEYS, "event_id"), ["bid_flow", "ask_flow", "ofi"]))
query("o11_ofi_features", lambda d: output(O.ofi_features(Series(d, order=("ts", "event_id")), book(d)), (*KEYS, "event_id"), ["ofi_z", "ofi_slope", "ofi_day"], ["divergence"]))
_bars("o12_order_imbalance", O.order_imbalance, ["signed_imbalance", "ratio_imbalance", "log_imbalance", "rolling_imbalance"])
_ticks("o13_large_blocks", O.large_blocks, ["cut", "z_size", "block_direction", "block_z"], ["block"])
query("o14_hedge_footprint", lambda d: output(O.hedge_footprint(Series(d), f"(select *, (close - open) * volume as option_flow, (high + low - 2 * close) * volume as stock_flow from {views.bars(d)} b)"), KEYS, ["hedge_corr"]))
_ticks("o15_spread_iceberg", O.spread_iceberg, ["balance", "same_size", "price_spread", "iceberg"])
_ticks("o16_sweeps", O.sweeps, [], ["run_length", "longest_run", "sweep"])
_ticks("o17_smart_money", O.smart_money, ["hedge", "balance", "iceberg", "smart_money_index"], ["sweep"])
query("o18_flow_features", lambda d: output(staged(O.price_impact(Series(d), O.bulk_volume(Series(d), views.bars(d))), {"impact_z": Series(d).z("impact", 252), "share_z": Series(d).z("buy_share", 252)}), KEYS, ["buy_share", "impact", "impact_z", "share_z"]))
_bars("o19_cumulative_delta", O.cumulative_delta, ["delta", "cumulative_delta", "month_delta"], digits=4)
_bars("o20_inventory", O.inventory, ["inventory_z", "pressure"], ["reversion"])
_bars("o21_inventory_features", O.inventory, ["inventory", "reservation"], ["reversion"], digits=4)
_bars("o24_quote_model", O.inventory, ["reservation", "half_spread", "best_bid", "best_ask"], digits=4)
query("o25_flow_snapshot", lambda d: f"select symbol, max(ts) as ts, round(cast({d.last('buy_share', 'ts')} as double), 6) as buy_share, round(cast({d.last('impact', 'ts')} as double), 6) as impact, round(cast({d.last('fit', 'ts')} as double), 6) as fit from {O.price_impact(Series(d), O.bulk_volume(Series(d), views.bars(d)))} x group by symbol")
query("o26_inventory_snapshot", lambda d: f"select symbol, max(ts) as ts, round({d.last('reservation', 'ts')}, 4) as reservation, round({d.last('pressure', 'ts')}, 6) as pressure, round({d.last('inventory_z', 'ts')}, 5) as inventory_z, {d.last('reversion', 'ts')} as reversion from {O.inventory(Series(d), views.bars(d))} x group by symbol")


def vixed(d):
    """Bars with a volatility index of their own: annualised deviation in points."""
    s = Series(d)
    return staged(views.bars(d), {"vix_return": f"ln(close / {s.lag('close')})"}, {"vix": f"round({s.roll('stddev_samp', 'vix_return', 20)} * 20, 6)"})


def returned(d):
    """Rows with a return."""
    return f"(select symbol, ts, close, volume, r from {views.returns(d)} x where r is not null)"


def labelled(d):
    """Bars with a trend label."""
    return f"(select symbol, ts, close, open, high, low, volume, label from {G.label_history(Series(d), views.bars(d))} l where label is not null)"


_bars("g01_trend_regime", G.trend_regime, ["momentum", "strength"], ["score", "trend"])
_bars("g02_vol_regime", G.vol_regime, ["vix", "change_1", "change_5", "vix_rank", "multiplier"], ["vol_level"], digits=6, source=vixed)
query("g03_combined_regime", lambda d: output(G.combined_regime(Series(d), G.trend_regime(Series(d), G.vol_regime(Series(d), vixed(d)))), KEYS, [], ["trend", "vol_level", "combined", *(f"is_state_{k}" for k in range(4))]))
_bars("g04_label_history", G.label_history, ["iv", "drawdown"], ["label"])
query("g06_moment_regime", lambda d: output(G.moment_regime(Series(d), f"(select symbol, ts, round(skew, 7) as skew, round(kurtosis, 7) as kurtosis from {B.moments(Series(d), views.returns(d), 30)} m)"), KEYS, ["skew", "kurtosis"], ["moment_state"], 7))
query("g07_term_structure", lambda d: output(G.term_structure(Series(d), f"(select symbol, ts, vix as front, {Series(d).roll('avg', 'vix', 60)} as back from {vixed(d)} v)"), KEYS, ["spread", "slope", "slope_change"], ["state", "zone"], 9))
query("g15_cusum_mean", lambda d: output(G.cusum_mean(Series(d), returned(d)), KEYS, ["z", "cusum_up", "cusum_down", "statistic"], ["alarm"], 4))
query("g16_cusum_variance", lambda d: output(G.cusum_variance(Series(d), returned(d)), KEYS, ["score", "statistic"], ["alarm"], 4))
query("g21_regime_runs", lambda d: f"select symbol, run, label, first_ts, last_ts, length, is_open from {G.regime_runs(Series(d), labelled(d))} r")
query("g22_hazard_table", lambda d: output(G.hazard_table(Series(d), G.regime_runs(Series(d), labelled(d))), ("label", "length"), ["hazard", "survival", "cumulative_hazard", "residual"], ["ended", "at_risk", "rising"]))
query("g23_fit_durations", lambda d: output(G.fit_durations(G.regime_runs(Series(d), labelled(d))), ("label",), ["mean", "variance", "log_mean", "log_dev", "geometric_p", "nb_p", "nb_r"], ["runs"]))


def timed(d):
    """Labelled bars with the time they have been in their regime, its length and the day it was known to be over."""
    return P.timed_runs(Series(d), labelled(d))


stored_query("g24_duration_features", timed, lambda d, rows: output(P.duration_features(Series(d), rows), KEYS, ["hazard", "survival", "remaining"], ["label", "time_in"]))
stored_query("g25_tv_transition", timed, lambda d, rows: output(P.transitions(d, Series(d), rows), (*KEYS, "to_label"), ["share", "p"], ["label", "time_in"]))
stored_query("g34_transition_risk", timed, lambda d, rows: output(P.transition_risk(d, Series(d), rows), KEYS, ["hazard", "remaining", "percentile"], ["label", "time_in", "runs"]))
query("g26_transition_matrix", lambda d: output(G.transition_matrix(Series(d), labelled(d)), ("from_label", "to_label"), ["share"], ["n"]))
_bars("g27_bar_state", G.bar_state, [], ["state"])


def stated(d):
    """Bars with their state code and the trend regime of the day."""
    return f"(select symbol, ts, close, state, trend as regime from {G.trend_regime(Series(d), G.bar_state(Series(d), views.bars(d)))} t)"


query("g28_pattern_table", lambda d: output(G.pattern_table(Series(d), stated(d)), ("sequence", "regime"), ["p_up", "edge"], ["n"]))


def sequenced(d):
    """Rows with their sequence of states, their regime, and the next day, on which it is known whether they rose."""
    s = Series(d)
    return staged(G.sequences(s, stated(d)), {"next_ts": s.lead("ts")})


#: The levels of `regimes.trend_regime`.
TRENDS = (-1, 0, 1, 2, 3, 4)
stored_query("g29_pattern_predict", sequenced, lambda d, rows: output(P.pattern_lookup(d, Series(d), rows, TRENDS), KEYS, ["p_up", "edge"], ["sequence", "support", "fallback", "signal"]))


def forces(d):
    """Long rows of several forces, each with its share of the past year below it, strength and velocity."""
    s = Series(d)
    wide = staged(O.bulk_volume(s, vixed(d)), {"momentum": f"close / {s.lag('close', 20)} - 1"})
    long = " union all ".join(f"select symbol, ts, '{f}' as force, cast({f} as double) as value, round(cast({f} as double), 9) as ranked from {wide} w" for f in ("vix", "momentum", "buy_share"))
    f = Series(d, ("symbol", "force"))
    # strength is a ninth of the rank, from whole numbers, so that no share falls short of its bin
    return staged(f"({long})", {"twice_rank": f.twice_rank("ranked", 252), "velocity": f"(value - {f.lag('value', 5)}) / 5"}, {"share": "twice_rank / cast(504 as double)", "strength": "least(8, cast(floor(twice_rank * 9 / cast(504 as double)) as int))"})


query("g30_force_table", lambda d: output(forces(d), ("symbol", "ts", "force"), ["value", "share", "velocity"], ["strength"]))
query("g32_slowdown_state", lambda d: f"select symbol, max(ts) as ts, round({d.last('ac_z', 'ts')}, 4) as ac_z, round({d.last('var_z', 'ts')}, 4) as var_z, case when {d.last('ac_z', 'ts')} > 1 and {d.last('var_z', 'ts')} > 1 then 'HIGH' when {d.last('ac_z', 'ts')} > 1 or {d.last('var_z', 'ts')} > 1 then 'ELEVATED' else 'NORMAL' end as state from {B.autocorr_warning(Series(d), views.returns(d))} a group by symbol")
query("g33_parametric_hazard", lambda d: output(G.duration_hazards(d, G.fit_durations(G.regime_runs(Series(d), labelled(d)))), ("label", "t"), ["geometric", "weibull", "log_logistic", "negative_binomial"], [], 6))
query("g36_dynamics_snapshot", lambda d: f"select symbol, round({d.last('vol', 'ts')}, 5) as vol, round({d.last('vol_velocity', 'ts')}, 5) as vol_velocity, {d.last('vol_trend', 'ts')} as vol_trend from {B.vol_dynamics(Series(d), views.bars(d))} v group by symbol")
query("g37_publishable_regime", lambda d: f"select symbol, max(ts) as ts, {d.last('trend', 'ts')} as trend, round({d.last('s20', 'ts')}, 5) as s20, round({d.last('strength', 'ts')}, 6) as strength from {G.trend_regime(Series(d), views.bars(d))} v group by symbol")
