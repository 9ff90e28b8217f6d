"""Calendar events around rows of a minute grain, by an interval join over time bins.

An event goes to the bins that its window touches, a row to the bin of its time; rows meet events by equality of bins and
are then checked exactly.  Events of one time are one row before they spread, so that a crowded minute isn't paired over.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..frames import Dialect, staged

#: Seconds of a bin; a window spreads over its length by this, and one.
BIN = 3600
#: Impacts from the gravest; minutes before and after an event in which entries are blocked; hours before it in which stops are tightened.
IMPACTS = ("RED", "ORANGE", "YELLOW")
BLOCK_BEFORE, BLOCK_AFTER, TIGHTEN_HOURS = 30, 60, 2.0


def by_time(d: Dialect, calendar: str) -> str:
    """Events (due, name, impact) of one time as a row: the gravest, the first by name, and how many there are."""
    rank = "case impact " + " ".join(f"when '{x}' then {k}" for k, x in enumerate(IMPACTS)) + f" else {len(IMPACTS)} end"
    return f"(select due, {d.first('name', 'gravity', 'name')} as name, {d.first('impact', 'gravity', 'name')} as impact, count(*) as n, {d.seconds('due')} as due_s from (select due, name, impact, {rank} as gravity from {calendar} c where due is not null) g group by due)"


def matched(d: Dialect, rows: str, keys: Sequence[str], calendar: str, before: int, after: int) -> str:
    """Rows (keys, ts) with each time of events of whose window they are in, from `before` seconds before to `after` seconds after it."""
    spread = f"(select *, {d.explode(d.series(f'cast(floor((due_s - {before}) / cast({BIN} as double)) as bigint)', f'cast(floor((due_s + {after}) / cast({BIN} as double)) as bigint)'), 'bin')} from {by_time(d, calendar)} e)"
    binned = f"(select {', '.join(keys)}, ts, {d.seconds('ts')} as ts_s, cast(floor({d.seconds('ts')} / cast({BIN} as double)) as bigint) as bin from {rows} r)"
    own = ", ".join(f"b.{k}" for k in [*keys, "ts"])
    return f"(select {own}, s.due, s.name, s.impact, s.n, (s.due_s - b.ts_s) / cast(60 as double) as minutes from {binned} b join {spread} s on b.bin = s.bin where b.ts_s >= s.due_s - {before} and b.ts_s <= s.due_s + {after})"


def event_windows(d: Dialect, rows: str, keys: Sequence[str], calendar: str, before: int = BLOCK_BEFORE, after: int = BLOCK_AFTER) -> str:
    """Rows inside the window of an event, with the first such event: name, impact, minutes to it and its position as text."""
    by = ", ".join([*keys, "ts"])
    found = matched(d, rows, keys, calendar, before * 60, after * 60)
    first = f"(select {by}, min(due) as due, {d.first('name', 'due')} as name, {d.first('impact', 'due')} as impact, {d.first('minutes', 'due')} as minutes, cast(sum(n) as bigint) as events from {found} m group by {by})"
    whole = "cast(cast(round(abs(minutes)) as bigint) as varchar(10))"
    return staged(first, {"position": f"concat(case when minutes > 0 then 'T-' else 'T+' end, {whole}, 'm')"})


def _rated(found: str) -> str:
    return staged(found, {"minutes_until": "cast(round(until_) as bigint)", "hours_until": "round(until_ / 60, 1)"}, {"tighten": f"case when hours_until <= {TIGHTEN_HOURS} then 1 else 0 end"})


def _next(d: Dialect, rows: str, keys: Sequence[str], calendar: str, within: int) -> str:
    """Rows (keys, ts) with the next event within so many seconds, and how many there are, without a row for each pair.

    Events of one second are one row.  The times of rows, and those `within` later, stand among the events of their bin, in
    order: what came before in the bin, and in all bins before, is counted, and the next event is the bin's or that of the
    next bin with one.  The only order over all is that of the bins, a row each.
    """
    by = ", ".join(keys)
    asked = f"(select {by}, ts, {d.seconds('ts')} as ts_s, count(*) as m from {rows} r group by {by}, ts)"
    probes = f"(select ts_s, explode(array(ts_s, ts_s + {within + 1})) as at from (select distinct ts_s from {asked} a) a0)"
    seconds = f"(select due_s as at, cast(null as bigint) as ts_s, sum(n) as n, min_by(struct(due_s, due, name, impact), due) as event from {by_time(d, calendar)} e group by due_s)"
    line = f"(select cast(floor(at / cast({BIN} as double)) as bigint) as bin, at, ts_s, n, event from (select at, ts_s, n, event from {seconds} s union all select at, ts_s, cast(0 as bigint) as n, null as event from {probes} p) u)"
    inside = f"(select bin, at, ts_s, sum(n) over (partition by bin order by at, ts_s nulls last rows between unbounded preceding and current row) as before, first(event, true) over (partition by bin order by at, ts_s nulls last rows between current row and unbounded following) as event from {line} l)"
    bins = f"(select bin, coalesce(sum(n) over (order by bin rows between unbounded preceding and 1 preceding), 0) as before, first(event, true) over (order by bin rows between 1 following and unbounded following) as event from (select bin, sum(n) as n, min_by(event, at) filter (where event is not null) as event from {line} l group by bin) g)"
    looked = f"(select i.ts_s, max(i.before + b.before) - min(i.before + b.before) as n, min_by(coalesce(i.event, b.event), i.at) as event from (select * from {inside} i0 where ts_s is not null) i join {bins} b on i.bin = b.bin group by i.ts_s)"
    own = ", ".join(f"a.{k}" for k in [*keys, "ts"])
    return f"(select {own}, f.event.due as due, f.event.name as name, f.event.impact as impact, (f.event.due_s - a.ts_s) / cast(60 as double) as until_, f.n * a.m as events from {asked} a join (select * from {looked} k where n > 0) f on a.ts_s = f.ts_s)"


def upcoming(d: Dialect, rows: str, keys: Sequence[str], calendar: str, hours: int = 24) -> str:
    """Rows with the next event within so many hours: minutes until it, hours to one digit, how many there are, and whether stops are tightened."""
    by = ", ".join([*keys, "ts"])
    if d.spark:
        return _rated(_next(d, rows, keys, calendar, hours * 3600))
    found = matched(d, rows, keys, calendar, hours * 3600, 0)
    nxt = f"(select {by}, min(due) as due, {d.first('name', 'due')} as name, {d.first('impact', 'due')} as impact, min(minutes) as until_, cast(sum(n) as bigint) as events from {found} m group by {by})"
    return _rated(nxt)
