"""Queries of exit sweeps and of weights for all assets."""

from __future__ import annotations

from ..frames import Dialect, output
from ..operators import allocation
from . import views
from .flow_queries import labelled
from .registry import query, stored_query

ASSETS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

stored_query(
    "e34_exit_rules",
    views.paths,
    lambda d, rows: output(allocation.exit_sweep(d, rows), ("rule",), ["total_pnl", "avg_pnl", "win_rate", "avg_days", "capture_rate", "avg_peak_pct", "delta_pnl", "delta_win_rate"], ["trades"], 4),
)


def panel(d: Dialect) -> str:
    """A row for each day: the returns of all assets, and the commonest label of the day, the first by name of equally common ones."""
    labels = f"(select ts, label, count(*) as n from {labelled(d)} l group by ts, label)"
    regime = f"(select ts, {d.first('label', '-n', 'label')} as regime from {labels} m group by ts)"
    columns = ", ".join(f"coalesce(max(case when symbol = '{a}' then r end), 0) as r_{a.lower()}" for a in ASSETS)
    return f"(select x.*, g.regime from (select ts, {columns} from {views.returns(d)} y where r is not null group by ts) x join {regime} g on x.ts = g.ts)"


WEIGHTS = [f"w{k}" for k in range(len(ASSETS))]
stored_query("e50_weight_search", panel, lambda d, rows: output(allocation.weight_search(d, rows, [f"r_{a.lower()}" for a in ASSETS]), ("regime", "objective"), [*WEIGHTS, "value"], ["n"], 6))


def arrays(d: Dialect) -> str:
    """Of each order's quantities, in the order of their lines: the first, the place of the first largest, and the running totals' middle one."""
    line = "struct(l_linenumber, l_quantity, l_extendedprice, l_partkey)"
    if d.spark:
        q = f"transform(array_sort(collect_list({line})), x -> cast(x.l_quantity as double))"
        place, sums = "array_position(q, array_max(q))", "transform(sequence(1, size(q)), i -> aggregate(slice(q, 1, i), cast(0 as double), (a, x) -> a + x))"
    else:
        q = "list(cast(l_quantity as double) order by l_linenumber, l_quantity, l_extendedprice, l_partkey)"
        place, sums = "list_position(q, list_max(q))", "list_transform(range(1, len(q) + 1), lambda i: list_sum(q[1:i]))"
    base = f"(select l_orderkey, {q} as q from {{lineitem}} group by l_orderkey)"
    n = d.size("q")
    return f"select l_orderkey, {d.item('q', 1)} as first_, cast({place} as bigint) as place, {d.item('sums', f'({n} + 1) / 2' if d.spark else f'({n} + 1) // 2')} as middle_total from (select *, {sums} as sums from {base} b) s"


query("m07_ordered_arrays", arrays)
