"""Queries of the quality gate over a feed with flaws, of modelled spreads, and of funnels."""

from __future__ import annotations

from ..frames import Dialect, Series, output, staged
from ..operators import funnels, gates
from . import views
from .registry import query, stored_query


def feed(d: Dialect) -> str:
    """The events as raw ticks: some prices have the wrong sign, more of them on some days of some symbols, and some sizes are missing."""
    flawed = "event_id % 151 = 0 or (event_id % 9 = 0 and (day(ts) + length(symbol)) % 5 = 0)"
    return f"(select symbol, {d.bucket('ts', 1440)} as day, ts, event_id, case when {flawed} then -price else price end as price, case when event_id % 17 = 0 then 0 else size end as size from {views.events_ticks(d)} e)"


METRICS = ["ticks", "bad_price", "zero_size", "jumps", "rejected", "suspect", "kept"]
gated = lambda d: gates.gated(d, feed(d))
stored_query("s05_gate_metrics", gated, lambda d, rows: output(gates.gate_metrics(rows), ("symbol", "day"), [], METRICS))
stored_query("s05_gate_ticks", gated, lambda d, rows: output(f"(select * from {rows} g where kept = 1)", ("symbol", "ts", "event_id"), ["price", "size"]))


def quoted(d: Dialect) -> str:
    """Quotes at the events' times: a strike below or above the price, days to expiry, and a volatility index from the last prices."""
    s = Series(d, order=("ts", "event_id"))
    rows = staged(views.events_ticks(d), {"vix": f"coalesce({s.roll('stddev_samp', 'price', 20)} / 2, 20)"})
    return f"(select symbol, ts, event_id, price as spot, price * (90 + event_id % 5 * 5) / 100 as strike, cast(size as int) % 30 as dte, vix, hour(ts) * 60 + minute(ts) - 570 as minutes, case when user_id % 3 = 0 then 1 else 0 end as strangle from {rows} r)"


query("c06_spread_factors", lambda d: output(gates.spread(quoted(d)), ("symbol", "ts", "event_id"), ["moneyness", "vol_factor", "time_factor", "spread"], ["dte", "strangle"]))

stored_query(
    "a22_stage_funnel",
    lambda d: "(select user_id as item, event_type as stage, ts from {events})",
    lambda d, rows: output(funnels.funnel(rows, ("signup", "view", "click", "purchase"), 7, d), ("step", "stage"), ["median_hours", "of_first", "of_previous"], ["items"], 5),
)
