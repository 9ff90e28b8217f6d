"""Bars of several timeframes by rolling up one mergeable state, and how the timeframes agree.

A bar's state holds its first and last price with their times, extremes, sums and a count.  States merge, so that bars of
a coarser timeframe come from those of the one below, not from the ticks: ticks are read once, and each level has at most
as many rows as the one below.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..frames import Dialect, Series, staged

#: The timeframes and their minutes, from the finest.
TIMEFRAMES = {"5min": 5, "15min": 15, "1H": 60, "1D": 1440}
_STATE = "first_ts, first_id, open, last_ts, last_id, close, high, low, volume, turnover, n"


def bar_states(d: Dialect, ticks: str, minutes: int, keys: Sequence[str] = ("symbol",)) -> str:
    """States of bars from ticks (keys, ts, event_id, price, size): keys, bar and the state."""
    by = ", ".join(keys)
    rows = f"(select {by}, {d.bucket('ts', minutes)} as bar, ts, event_id, price, size from {ticks} t where price is not null)"
    return f"(select {by}, bar, min(ts) as first_ts, {d.first('event_id', 'ts', 'event_id')} as first_id, {d.first('price', 'ts', 'event_id')} as open, max(ts) as last_ts, {d.last('event_id', 'ts', 'event_id')} as last_id, {d.last('price', 'ts', 'event_id')} as close, max(price) as high, min(price) as low, sum(size) as volume, sum(price * size) as turnover, count(*) as n from {rows} r group by {by}, bar)"


def merged(d: Dialect, states: str, minutes: int, keys: Sequence[str] = ("symbol",)) -> str:
    """States of coarser bars from states of finer ones."""
    by = ", ".join(keys)
    rows = f"(select {by}, {d.bucket('bar', minutes)} as bar, {_STATE} from {states} s)"
    first, last = ("first_ts", "first_id"), ("last_ts", "last_id")
    return f"(select {by}, bar, min(first_ts) as first_ts, {d.first('first_id', *first)} as first_id, {d.first('open', *first)} as open, max(last_ts) as last_ts, {d.last('last_id', *last)} as last_id, {d.last('close', *last)} as close, max(high) as high, min(low) as low, sum(volume) as volume, sum(turnover) as turnover, sum(n) as n from {rows} r group by {by}, bar)"


def levels(d: Dialect, states: str, keys: Sequence[str] = ("symbol",)) -> dict[str, str]:
    """The bars of every timeframe, each from the one below; states: of the finest."""
    out, below = {}, states
    for k, (name, minutes) in enumerate(TIMEFRAMES.items()):
        below = merged(d, below, minutes, keys) if k else states
        out[name] = below
    return out


def timeframe_bars(d: Dialect, states: str, keys: Sequence[str] = ("symbol",)) -> str:
    """All timeframes' bars in one relation: timeframe, keys, ts, prices, volume, vwap and n."""
    by = ", ".join(keys)
    parts = (f"select '{name}' as timeframe, {by}, bar as ts, open, high, low, close, volume, turnover / nullif(volume, 0) as vwap, n from {sql} b{k}" for k, (name, sql) in enumerate(levels(d, states, keys).items()))
    return f"({' union all '.join(parts)})"


def timeframe_features(d: Dialect, states: str) -> str:
    """Bars of every timeframe with returns over one and five bars, the distance from the mean of ten, and the place in the range of ten."""
    s = Series(d, ("timeframe", "symbol"))
    return staged(
        timeframe_bars(d, states),
        {"ret_1": f"{d.ratio('close', s.lag('close'))} - 1", "ret_5": f"{d.ratio('close', s.lag('close', 5))} - 1", "momentum": f"{d.ratio('close', s.roll('avg', 'close', 10))} - 1", "top": s.roll("max", "high", 10), "bottom": s.roll("min", "low", 10)},
        {"range_place": "(close - bottom) / nullif(top - bottom, 0)"},
    )


def last_of_day(d: Dialect, features: str, columns: Sequence[str]) -> str:
    """Each timeframe's last value of every day: what was known at its close.  A missing value doesn't hide an earlier one of the day."""
    own = lambda c: f"max(case when {c} is not null then ts end)"
    day = d.bucket("ts", 1440)
    marks = f"(select timeframe, symbol, {day} as day, {', '.join(f'{own(c)} as at_{c}' for c in columns)} from {features} f group by timeframe, symbol, {day})"
    picked = ", ".join(f"max(case when x.ts = m.at_{c} then x.{c} end) as {c}" for c in columns)
    return f"(select m.timeframe, m.symbol, m.day, {picked} from {marks} m join {features} x on m.timeframe = x.timeframe and m.symbol = x.symbol and m.day = {d.bucket('x.ts', 1440)} group by m.timeframe, m.symbol, m.day)"


def alignment(d: Dialect, daily: str) -> str:
    """Whether adjacent timeframes' five-bar returns and momenta point the same way, the products of the returns, and whether all agree.

    daily: of last_of_day, with ret_5 and momentum.  A row for each symbol and day; unknown signs don't agree.
    """
    names = list(TIMEFRAMES)
    wide = ", ".join(f"max(case when timeframe = '{n}' then {c} end) as {c}_{k}" for k, n in enumerate(names) for c in ("ret_5", "momentum"))
    rows = f"(select symbol, day, {wide} from {daily} d0 group by symbol, day)"
    agree = lambda c, k: f"case when {d.sign(f'{c}_{k}')} = {d.sign(f'{c}_{k + 1}')} then 1 else 0 end"
    pairs = range(len(names) - 1)
    return staged(
        rows,
        {f"align_{k}": agree("ret_5", k) for k in pairs} | {f"momentum_align_{k}": agree("momentum", k) for k in pairs} | {f"strength_{k}": f"ret_5_{k} * ret_5_{k + 1}" for k in pairs},
        {"cascade": " * ".join(f"align_{k}" for k in pairs)},
    )
