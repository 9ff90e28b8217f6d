"""Contracts that trades ask for, looked up in the chain of their day: exact, in bulk, and nearest on two axes.

wanted: id, symbol, ts, opt, dte, strike.  chain: symbol, ts, opt, dte, strike, and columns to return.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..frames import Dialect, staged

#: How far a strike may be off in an exact look-up; how far expiry and strike may be in the nearest one.
TOLERANCE, MOST_DAYS, MOST_STRIKE = 0.01, 90, 500.0
_DAY = ("symbol", "ts", "opt")


def exact(d: Dialect, wanted: str, chain: str, columns: Sequence[str]) -> str:
    """Wanted contracts with the chain's of the same day, side and expiry whose strike is less than a cent away; null columns if there is none.

    A wanted strike looks in its own cent and those beside it; of several in reach the lowest strike counts.
    """
    cent = lambda x: f"cast(floor({x} * 100) as bigint)"
    if d.spark:  # the chain spreads over the cents that it is near to, a row each, and each wanted contract is joined once
        kept = ", ".join(columns)
        days = ", ".join((*_DAY, "dte"))
        offers = f"(select {days}, strike, {', '.join(f'{d.first(x, "strike")} as {x}' for x in columns)} from {chain} k where strike is not null group by {days}, strike)"
        spread = f"(select {days}, cent, array_sort(array_agg(struct(strike, {kept}))) as offers from (select *, {d.explode(d.series(f'{cent("strike")} - 2', f'{cent("strike")} + 2'), 'cent')} from {offers} o) x group by {days}, cent)"
        on = " and ".join(f"w.{k} = c.{k}" for k in (*_DAY, "dte"))
        found = f"(select w.*, get(filter(c.offers, o -> abs(w.strike - o.strike) < {TOLERANCE}), 0) as offer from {wanted} w left join {spread} c on {on} and {cent('w.strike')} = c.cent)"
        return f"(select * except (offer), offer.strike as found_strike, {', '.join(f'offer.{x} as {x}' for x in columns)} from {found} f)"
    near = f"(select *, {d.explode(d.series(f'{cent("strike")} - 2', f'{cent("strike")} + 2'), 'cent')} from {wanted} w)"
    on = " and ".join(f"w.{k} = c.{k}" for k in (*_DAY, "dte"))
    hits = f"(select w.id, c.strike as found_strike, {', '.join(f'c.{x}' for x in columns)} from {near} w join (select *, {cent('strike')} as cent from {chain} k) c on {on} and w.cent = c.cent where abs(w.strike - c.strike) < {TOLERANCE})"
    one = f"(select id, min(found_strike) as found_strike, {', '.join(f'{d.first(x, "found_strike")} as {x}' for x in columns)} from {hits} h group by id)"
    return f"(select w.*, o.found_strike, {', '.join(f'o.{x}' for x in columns)} from {wanted} w left join {one} o on w.id = o.id)"


def bulk(wanted: str, chain: str, columns: Sequence[str]) -> str:
    """Wanted contracts that the chain has, by equality of the whole contract."""
    on = " and ".join(f"w.{k} = c.{k}" for k in (*_DAY, "dte", "strike"))
    return f"(select w.*, {', '.join(f'c.{x}' for x in columns)} from {wanted} w join {chain} c on {on})"


def _sides(d: Dialect, asks: str, offers: str, by: Sequence[str], axis: str, name: str, keep: Sequence[str]) -> str:
    """Asks with the last offer at or below their value of an axis, and the first at or above it, by one order in either direction."""
    keys = ", ".join(by)
    both = f"(select {keys}, {axis}, {', '.join(keep)}, 1 as asks from {asks} a union all select {keys}, {axis}, {', '.join(f'cast(null as {kind}) as {k}' for k, kind in ((k, 'bigint' if k == 'id' else 'double') for k in keep))}, 0 as asks from {offers} o)"
    seen = d.last_seen(f"case when asks = 0 then {axis} end")
    frame = "rows between unbounded preceding and current row"
    rows = staged(both, {f"{name}_below": f"{seen} over (partition by {keys} order by {axis}, asks {frame})", f"{name}_above": f"{seen} over (partition by {keys} order by {axis} desc, asks {frame})"})
    return f"(select * from {rows} z where asks = 1)"


def nearest(d: Dialect, wanted: str, chain: str, columns: Sequence[str]) -> str:
    """Wanted contracts with the chain's nearest of their day and side: least distance of expiry, then of strike; none beyond the caps.

    Each axis is a two-sided look along one sorted group; of equally near expiries both are followed.  Ties go to the lower
    expiry, then to the lower strike.
    """
    if d.spark:
        return _nearest_of_day(d, wanted, chain, columns)
    asks = f"(select symbol, ts, opt, cast(dte as double) as dte, cast(strike as double) as strike, cast(id as bigint) as id from {wanted} w)"
    expiries = f"(select distinct symbol, ts, opt, cast(dte as double) as dte from {chain} k)"
    near = _sides(d, asks, expiries, _DAY, "dte", "dte", ("id", "strike"))
    gaps = staged(near, {"gap_below": "dte - dte_below", "gap_above": "dte_above - dte"}, {"gap": "least(coalesce(gap_below, gap_above), coalesce(gap_above, gap_below))"})
    side = lambda s: f"select id, symbol, ts, opt, strike, dte_{s} as dte, gap from {gaps} g{s[0]} where gap_{s} = gap"
    picked = f"(select distinct * from ({side('below')} union all {side('above')}) u where gap <= {MOST_DAYS})"
    offers = f"(select distinct symbol, ts, opt, cast(dte as double) as dte, cast(strike as double) as strike from {chain} k)"
    both = _sides(d, picked, offers, (*_DAY, "dte"), "strike", "strike", ("id", "gap"))
    side = lambda s: f"select id, symbol, ts, opt, dte, gap, strike_{s} as strike, abs(strike - strike_{s}) as off from {both} b{s[0]} where strike_{s} is not null"
    candidates = f"(select * from ({side('below')} union all {side('above')}) v)"
    best = f"(select id, symbol, ts, opt, {d.first('dte', 'gap', 'off', 'dte', 'strike')} as dte, {d.first('strike', 'gap', 'off', 'dte', 'strike')} as strike, min(gap) as days_off, {d.first('off', 'gap', 'off', 'dte', 'strike')} as strike_off from {candidates} c group by id, symbol, ts, opt)"
    on = " and ".join(f"b.{k} = c.{k}" for k in (*_DAY, "dte", "strike"))
    found = f"(select b.*, {', '.join(f'c.{x}' for x in columns)} from {best} b join {chain} c on {on} where b.strike_off <= {MOST_STRIKE})"
    return f"(select w.*, f.dte as found_dte, f.strike as found_strike, f.days_off, f.strike_off, {', '.join(f'f.{x}' for x in columns)} from {wanted} w left join {found} f on w.id = f.id)"


def _nearest_of_day(d: Dialect, wanted: str, chain: str, columns: Sequence[str]) -> str:
    """The same with each wanted contract joined once to the offers of its day and side, which are a row: a sorted list of expiries, each with its sorted strikes.

    Of the expiries those of the least distance are looked into, two at most.  Of a contract that the chain has twice, one counts.
    """
    days = ", ".join(_DAY)
    offers = f"(select {days}, cast(dte as double) as dte, cast(strike as double) as strike, {', '.join(f'{d.first(x, *columns)} as {x}' for x in columns)} from {chain} k where strike is not null and dte is not null group by {days}, cast(dte as double), cast(strike as double))"
    expiries = f"(select {days}, dte, array_agg(struct(strike, {', '.join(columns)})) as strikes from {offers} o group by {days}, dte)"
    sides = f"(select {days}, array_agg(struct(dte, strikes)) as expiries from {expiries} e group by {days})"
    on = " and ".join(f"w.{k} = c.{k}" for k in _DAY)
    gaps = f"(select w.*, c.expiries, array_min(transform(c.expiries, e -> abs(w.dte - e.dte))) as gap from {wanted} w left join {sides} c on {on})"
    near = f"(select g.* except (expiries), filter(g.expiries, e -> abs(g.dte - e.dte) = g.gap) as near from {gaps} g)"
    each = f"array_min(flatten(transform(f.near, e -> transform(e.strikes, s -> struct(abs(f.strike - s.strike) as off, e.dte as dte, s.strike as strike, {', '.join(f's.{x} as {x}' for x in columns)})))))"
    best = f"(select f.* except (near), case when f.gap <= {MOST_DAYS} and f.strike is not null then {each} end as best from {near} f)"
    one = f"(select * except (gap, best), gap, case when best.off <= {MOST_STRIKE} then best end as best from {best} b)"
    return f"(select * except (gap, best), best.dte as found_dte, best.strike as found_strike, case when best is not null then gap end as days_off, best.off as strike_off, {', '.join(f'best.{x} as {x}' for x in columns)} from {one} o)"
