"""Queries of intraday bars: every timeframe from the one below, and their agreement."""

from __future__ import annotations

from ..frames import Dialect, output
from ..operators import rollup
from . import views
from .registry import stored_query


def five_minutes(d: Dialect) -> str:
    return rollup.bar_states(d, views.events_ticks(d), 5)


FEATURES = ("ret_1", "ret_5", "momentum", "range_place")
BAR = ["open", "high", "low", "close", "volume", "vwap"]

stored_query("a02_resample_intraday", five_minutes, lambda d, rows: output(rollup.timeframe_bars(d, rows), ("timeframe", "symbol", "ts"), BAR, ["n"], 9))
stored_query("a04_daily_from_minutes", five_minutes, lambda d, rows: output(f"(select *, bar as day, turnover / nullif(volume, 0) as vwap from {rollup.levels(d, rows)['1D']} x)", ("symbol", "day"), BAR, ["n"], 9))


def contract_ticks(d: Dialect) -> str:
    """Trades of option contracts: the kind of event as the root, the side by the user, the strike by the price."""
    code = "concat('O:', upper(symbol), '240216', case when user_id % 2 = 0 then 'C' else 'P' end, lpad(cast(cast(floor(price / 50) * 50000 as bigint) as varchar(20)), 8, '0'))"
    return f"(select {code} as contract, ts, event_id, price, size from {views.events_ticks(d)} e)"


stored_query(
    "a03_resample_15min",
    lambda d: rollup.bar_states(d, contract_ticks(d), 15, ("contract",)),
    lambda d, rows: output(f"(select *, bar as ts from {rows} x)", ("contract", "ts"), ["open", "high", "low", "close", "volume"], ["n"]),
)
stored_query("a05_last_value_timeframes", lambda d: rollup.timeframe_features(d, five_minutes(d)), lambda d, rows: output(rollup.last_of_day(d, rows, FEATURES), ("timeframe", "symbol", "day"), FEATURES, [], 7))
PAIRS = range(len(rollup.TIMEFRAMES) - 1)
stored_query(
    "b29_timeframe_cascade",
    lambda d: rollup.timeframe_features(d, five_minutes(d)),
    lambda d, rows: output(rollup.alignment(d, rollup.last_of_day(d, rows, ("ret_5", "momentum"))), ("symbol", "day"), [f"strength_{k}" for k in PAIRS], [*(f"align_{k}" for k in PAIRS), *(f"momentum_align_{k}" for k in PAIRS), "cascade"], 9),
)
