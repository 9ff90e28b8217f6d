"""Funnels: items that went through stages in their order."""

from __future__ import annotations

from collections.abc import Sequence


def funnel(events: str, stages: Sequence[str], days: int, d) -> str:
    """Items that reached each stage after all those before it, within so many days of the first: counts, shares and median hours.

    events: item, stage, ts.  An item's stage counts from its first event of that stage at or after the time at which it
    reached the one before; later stages that it skipped to don't count.
    """
    at = f"(select item, min(ts) as t0, min(ts) as t from {events} e0 where stage = '{stages[0]}' group by item)"
    parts = []
    for k, stage in enumerate(stages):
        if k:
            at = f"(select a.item, a.t0, min(e.ts) as t from {at} a join {events} e on a.item = e.item where e.stage = '{stage}' and e.ts >= a.t and {d.seconds('e.ts')} - {d.seconds('a.t0')} <= {days * 86400} group by a.item, a.t0)"
        hours = d.quantile(f"({d.seconds('t')} - {d.seconds('t0')}) / cast(3600 as double)", 0.5)
        parts.append(f"select {k + 1} as step, '{stage}' as stage, count(*) as items, {hours} as median_hours from {at} p{k}")
    rows = f"({' union all '.join(parts)})"
    return f"(select *, cast(100 as double) * items / nullif(max(items) over (), 0) as of_first, cast(100 as double) * items / nullif(lag(items) over (order by step), 0) as of_previous from {rows} r)"
