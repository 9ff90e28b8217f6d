"""Exit rules swept over marked paths, and weights searched on a grid of all assets."""

from __future__ import annotations

from collections.abc import Sequence

from ..frames import Dialect, staged

#: Days held of the fixed rules and of the baseline; profits that arm a trailing stop, and falls from the peak that fire it.
HOLDS, BASELINE = (2, 3, 5, 7, 10), 14
ARMED, TRAILS = (150, 300, 500), (100, 200, 300)
YEAR = 252.0


def exit_rules() -> dict[str, tuple]:
    """Names and parameters of all rules, the baseline first."""
    rules: dict[str, tuple] = {f"day_{BASELINE}": (BASELINE,)}
    rules |= {f"day_{h}": (h,) for h in HOLDS}
    return rules | {f"trail_{k}_{t}": (k, t) for k in ARMED for t in TRAILS}


def exit_sweep(d: Dialect, paths: str) -> str:
    """Profit, win rate, days held and capture of each rule, and its differences to the baseline.

    paths: trade_id, day (from 1), pnl.  A fixed rule leaves after so many days, on the last day at the latest.  A trailing stop
    is armed once the profit reaches its level, and leaves on the first day on which it lies the trail below its peak since
    then.  The capture is held against the peak up to the exit, not against what came later.
    """
    rows = staged(paths, {"top": "max(pnl) over (partition by trade_id order by day rows between unbounded preceding and current row)", "days": "count(*) over (partition by trade_id)"})
    # the peak since a stop was armed is the peak so far, as what came before was lower
    day = lambda p: f"least({p[0] + 1}, max(days))" if len(p) == 1 else f"coalesce(min(case when top >= {p[0]} and pnl <= top - {p[1]} then day end), max(days))"
    rules = exit_rules()
    exits = f"(select trade_id, {', '.join(f'{day(p)} as x{k}' for k, p in enumerate(rules.values()))} from {rows} r group by trade_id)"
    long = " union all ".join(f"select trade_id, '{name}' as rule, x{k} as day from {exits} e{k}" for k, name in enumerate(rules))
    left = f"(select l.rule, l.day, r.pnl, r.top from ({long}) l join {rows} r on l.trade_id = r.trade_id and l.day = r.day)"
    one = "cast(1 as double)"
    sums = f"(select rule, count(*) as trades, sum(pnl) as total_pnl, avg(pnl) as avg_pnl, 100 * avg(case when pnl > 0 then {one} else 0 end) as win_rate, avg(cast(day as double)) as avg_days, case when sum(top) > 0 then 100 * sum(pnl) / nullif(sum(top), 0) else 0.0 end as capture_rate, avg(case when top <> 0 then 100 * pnl / nullif(top, 0) end) as avg_peak_pct from {left} x group by rule)"
    return f"(select s.*, s.total_pnl - b.total_pnl as delta_pnl, s.win_rate - b.win_rate as delta_win_rate from {sums} s cross join (select total_pnl, win_rate from {sums} b0 where rule = 'day_{BASELINE}') b)"


def weight_candidates(d: Dialect, assets: int, parts: int = 5, most: int = 3) -> str:
    """All ways to deal `parts` equal shares to the assets, at most `most` to one: candidate, w0, w1, ..."""
    table = "(select 0 as taken)"
    for k in range(assets - 1):
        table = f"(select *, {d.explode(d.series('0', f'least({most}, {parts} - taken)'), f'u{k}')} from {table} g{k})"
        own = " + ".join(f"u{i}" for i in range(k + 1))
        columns = ", ".join(f"u{i}" for i in range(k + 1))
        table = f"(select {own} as taken, {columns} from {table} h{k})"
    last = assets - 1
    name = " + ".join(f"cast(u{k} as bigint) * {(parts + 1) ** k}" for k in range(last))
    weights = ", ".join(f"u{k} / cast({parts} as double) as w{k}" for k in range(last))
    return f"(select {name} as candidate, {weights}, ({parts} - taken) / cast({parts} as double) as w{last} from {table} t where {parts} - taken <= {most})"


def weight_search(d: Dialect, wide: str, assets: Sequence[str], least: int = 20) -> str:
    """The best weights of every regime for Sharpe, Sortino, mean return and smallest drawdown.

    wide: ts, regime, and a column of returns for each asset, 0 where it has none.  A candidate is held against all days
    of a regime; the candidates are as many as the grid has, whatever the number of days.
    """
    weights = ", ".join(f"w{k}" for k in range(len(assets)))
    rows = f"(select regime, ts, candidate, {weights}, {' + '.join(f'{a} * w{k}' for k, a in enumerate(assets))} as r from {wide} x cross join {weight_candidates(d, len(assets))} c)"
    by = "partition by regime, candidate order by ts rows between unbounded preceding and current row"
    rows = staged(rows, {"wealth": f"exp(sum(ln(greatest(1 + r, 1e-9))) over ({by}))"}, {"peak": f"max(wealth) over ({by})"})
    sums = f"(select regime, candidate, {', '.join(f'min({w}) as {w}' for w in weights.split(', '))}, count(*) as n, avg(r) * {YEAR} as mean, stddev_samp(r) * sqrt({YEAR}) as dev, sqrt(avg(least(r, 0) * least(r, 0))) * sqrt({YEAR}) as down, min((wealth - peak) / peak) as drawdown from {rows} s group by regime, candidate having count(*) >= {least})"
    objectives = {"sharpe": "mean / nullif(dev, 0)", "sortino": "mean / nullif(down, 0)", "max_return": "mean", "min_drawdown": "drawdown"}
    long = " union all ".join(f"select regime, '{o}' as objective, candidate, n, {weights}, round({e}, 9) as value from {sums} z{k}" for k, (o, e) in enumerate(objectives.items()))
    ranked = f"(select *, row_number() over (partition by regime, objective order by value desc, candidate) as k from ({long}) y where value is not null)"
    return f"(select regime, objective, n, {weights}, value from {ranked} q where k = 1)"
