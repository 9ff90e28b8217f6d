"""Queries of look-ups between two tables: calendar events around bars, and contracts that trades ask for in the day's chain."""

from __future__ import annotations

from ..frames import Dialect, output
from ..operators import chains as A
from ..operators import contracts as C
from ..operators import events as V
from ..operators import rollup
from . import views
from .registry import query


def calendar(d: Dialect) -> str:
    """Errors as grave events and sign-ups as lesser ones, named by kind and user."""
    return "(select ts as due, concat(event_type, '-', cast(user_id as varchar(20))) as name, case when event_type = 'error' then 'RED' else 'ORANGE' end as impact from {events} where event_type in ('error', 'signup'))"


def minute_bars(d: Dialect) -> str:
    """Five-minute bars of the other kinds of events."""
    return f"(select symbol, bar as ts, close from {rollup.bar_states(d, f'''(select * from {views.events_ticks(d)} e where symbol not in ('error', 'signup'))''', 5)} b)"


query("c16_event_minutes", lambda d: output(V.event_windows(d, minute_bars(d), ("symbol",), calendar(d)), ("symbol", "ts"), ["minutes"], ["due", "name", "impact", "position", "events"], 4))
query("c17_upcoming_minutes", lambda d: output(V.upcoming(d, minute_bars(d), ("symbol",), calendar(d), 24), ("symbol", "ts"), ["hours_until"], ["due", "name", "impact", "minutes_until", "events", "tighten"], 2))


def wanted(d: Dialect) -> str:
    """A contract for each line of an order: expiries that are in the chain or 45 days, strikes some percents from the trade's price."""
    order = ("l_extendedprice", "l_quantity", "l_suppkey")
    lines = f"(select l_orderkey, l_linenumber, {d.first('symbol', *order)} as symbol, {d.first('ts', *order)} as ts, {d.first('price', *order)} as price from {views.ticks(d)} t group by l_orderkey, l_linenumber)"
    return f"(select l_orderkey * 100 + l_linenumber as id, symbol, ts, case when l_linenumber % 2 = 0 then 'P' else 'C' end as opt, case l_orderkey % 4 when 0 then 7 when 1 then 30 when 2 then 60 else 45 end as dte, floor(price * (100 + 3 * (l_linenumber % 5 - 2))) / cast(100 as double) as strike from {lines} x)"


def quotes(d: Dialect) -> str:
    """The chain with its prices; strikes of a low spot that fall together are one contract."""
    return f"(select symbol, ts, opt, dte, strike, max(price) as price, cast(max(oi) as bigint) as oi from {A.greeks(views.chain(d))} g group by symbol, ts, opt, dte, strike)"


ASKED = ("id", "symbol", "ts", "opt", "dte")
query("j05_contract_lookup", lambda d: output(C.exact(d, wanted(d), quotes(d), ("price", "oi")), ASKED, ["strike", "found_strike", "price"], ["oi"]))
query("j06_closest_contract", lambda d: output(C.nearest(d, wanted(d), quotes(d), ("price", "oi")), ASKED, ["strike", "found_dte", "found_strike", "days_off", "strike_off", "price"], ["oi"]))
query("j07_bulk_prices", lambda d: output(C.bulk(wanted(d), quotes(d), ("price", "oi")), ASKED, ["strike", "price"], ["oi"]))
