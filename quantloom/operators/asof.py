"""Tables as they were known on each day: durations, transitions and patterns without a look ahead.

An outcome counts from the day on which it was known: a run from the day on which the next one began, a move from the day
of its second row.  Events are summed by key and day first; running sums over days then hold a row for each key and day
that has an event or is asked for, so that rows meet the table of their own day by equality, and a window holds days, not
rows.  Relations are SQL for both engines.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..frames import Dialect, Series, staged

#: The labels of `regimes.label_history`; the scale and shape of the standard hazard of a transition; what is
#: said of a label with fewer than three closed runs (hazard, remaining time, percentile).
LABELS = ("bear", "bull", "crisis", "sideways", "volatile_bull")
WEIBULL_SHAPE, WEIBULL_SCALE = 1.5, 50.0
UNKNOWN_HAZARD, UNKNOWN_REST, UNKNOWN_PERCENTILE = 0.05, 20.0, 0.5
LEAST_RUNS = 3


def running(events: str, asks: str, keys: Sequence[str], sums: Sequence[str], day: str = "day") -> str:
    """Sums of the events up to and with each day, by key: a row for each key and day of an event or of `asks` (keys, day)."""
    by = ", ".join([*keys, day])
    both = f"(select {by}, {', '.join(sums)} from {events} e union all select {by}, {', '.join('0' for _ in sums)} from (select distinct {by} from {asks} a0) a)"
    daily = f"(select {by}, {', '.join(f'sum({x}) as {x}' for x in sums)} from {both} u group by {by})"
    over = f"over ({f'partition by {', '.join(keys)} ' if keys else ''}order by {day} rows between unbounded preceding and current row)"
    return f"(select {by}, {', '.join(f'sum({x}) {over} as {x}' for x in sums)} from {daily} q)"


def timed_runs(s: Series, source: str, label: str = "label") -> str:
    """Rows with the number of their run, the time they have been in it, and its length and the day it was known to be over (null if it isn't)."""
    keys = ", ".join(s.keys)
    o = s.order[0]
    rows = staged(source, {"turn": f"case when {label} is distinct from {s.lag(label)} then 1 else 0 end"}, {"run": f"sum(turn) {s.U}"}, {"time_in": f"row_number() over (partition by {keys}, run order by {', '.join(s.order)})"})
    runs = f"(select {keys}, run, min({o}) as began, count(*) as all_rows from {rows} r group by {keys}, run)"
    ended = f"(select {keys}, run, all_rows, lead(began) over (partition by {keys} order by run) as known_at from {runs} q)"
    on = " and ".join(f"r.{k} = x.{k}" for k in [*s.keys, "run"])
    return f"(select r.*, case when x.known_at is not null then x.all_rows end as run_length, x.known_at from {rows} r join {ended} x on {on})"


def duration_features(s: Series, rows: str) -> str:
    """Hazard, survival and expected remaining time of each row's label at its time in the run, from the runs over by its day.

    rows: of timed_runs.  A closed run of n rows was at risk at 1 to n, so its own rows are the events.  Before three runs of
    the label are over the hazard is 0 and the survival 1; beyond the longest run that is over they are 1 and 0.
    """
    events = f"(select label, time_in, known_at as day, 1 as at_risk, case when time_in = run_length then 1 else 0 end as ended, run_length - time_in as rest from {rows} v where known_at is not null and label is not null)"
    day = s.order[0]
    asks = f"(select label, time_in, {day} as day from {rows} w where label is not null union all select label, 1, {day} from {rows} y where label is not null)"
    table = running(events, asks, ("label", "time_in"), ("at_risk", "ended", "rest"))
    joined = f"(select r.*, h.at_risk, h.ended, h.rest, f.at_risk as runs_over from {rows} r left join {table} h on r.label = h.label and r.time_in = h.time_in and r.{day} = h.day left join (select * from {table} g where time_in = 1) f on r.label = f.label and r.{day} = f.day)"
    some = f"runs_over >= {LEAST_RUNS}"
    return staged(
        joined,
        {
            "hazard": f"case when label is null then null when {some} then case when at_risk > 0 then cast(ended as double) / at_risk else 1.0 end else 0.0 end",
            "survival": f"case when label is null then null when {some} then cast(at_risk - ended as double) / runs_over else 1.0 end",
            "remaining": f"case when label is null then null when {some} and at_risk > ended then cast(rest as double) / (at_risk - ended) else 0.0 end",
        },
    )


def transitions(d: Dialect, s: Series, rows: str, labels: Sequence[str] = LABELS) -> str:
    """Probability of each next label for every row: the shares of transitions seen by its day, scaled by a hazard that rises with the time in the run.

    A row stays with 1 - hazard, and moves with hazard times the share; the probabilities of a row are scaled to one.
    """
    day = s.order[0]
    steps = f"(select {s.lag('label')} as from_label, label as to_label, {day} as day, 1 as n from {rows} v)"
    steps = f"(select * from {steps} z where from_label is not null and to_label is not null)"
    names = ", ".join(f"'{x}'" for x in labels)
    every = f"explode(array({names}))" if d.spark else f"unnest([{names}])"
    asks = f"(select label as from_label, {every} as to_label, {day} as day from (select distinct label, {day} from {rows} w where label is not null) w1)"
    table = running(steps, asks, ("from_label", "to_label"), ("n",))
    shares = f"(select *, cast(n as double) / nullif(sum(n) over (partition by from_label, day), 0) as share from {table} t)"
    keys = ", ".join(f"r.{k}" for k in [*s.keys, *s.order])
    hazard = f"{WEIBULL_SHAPE / WEIBULL_SCALE} * power(time_in / {WEIBULL_SCALE}, {WEIBULL_SHAPE - 1})"
    moved = f"(select {keys}, r.label, r.time_in, t.to_label, coalesce(t.share, 0) as share, {hazard} as hazard from {rows} r join {shares} t on r.label = t.from_label and r.{day} = t.day)"
    own = ", ".join([*s.keys, *s.order])
    return staged(
        moved,
        {"part": "case when label = to_label then 1 - hazard else hazard * share end"},
        {"whole": f"sum(part) over (partition by {own})"},
        {"p": f"case when whole > 1e-10 then part / whole else {1 / len(labels)} end"},
    )


def transition_risk(d: Dialect, s: Series, rows: str) -> str:
    """Each instrument's last row: hazard at its time in the run, expected remaining time and percentile, from the closed runs of its label.

    The hazard is a negative binomial's, fitted by moments to lengths less one; a geometric's where they don't vary more
    than their mean.  Labels with fewer than three closed runs have stated values.
    """
    keys = ", ".join(s.keys)
    last = f"(select * from (select *, row_number() over (partition by {keys} order by {', '.join(f'{o} desc' for o in s.order)}) as back from {rows} v) v1 where back = 1)"
    closed = f"(select * from {rows} w where known_at is not null and time_in = run_length)"
    on = " and ".join(f"c.{k} = l.{k}" for k in s.keys)
    own = ", ".join(f"l.{k}" for k in [*s.keys, *s.order])
    fit = f"(select {own}, l.label, l.time_in, count(c.run_length) as runs, avg(cast(c.run_length as double)) as mean, var_samp(cast(c.run_length as double)) as variance, avg(case when c.run_length <= l.time_in then cast(1 as double) when c.run_length is not null then cast(0 as double) end) as share from {last} l left join {closed} c on {on} and c.label = l.label group by {own}, l.label, l.time_in)"
    fit = staged(fit, {"wide": "case when variance > mean then 1 else 0 end"}, {"p": "case when wide = 1 then (mean - 1) / variance else 1 / mean end"}, {"r": "case when wide = 1 then (mean - 1) * p / (1 - p) else 1.0 end"})
    grid = f"(select *, {d.explode(d.series('0', 'time_in - 1'), 'x')} from {fit} f where runs >= {LEAST_RUNS})"
    # logarithms of C(x + r - 1, x) as sums of those of its factors
    grid = staged(grid, {"log_c": f"sum(case when x > 0 then ln((x - 1 + r) / x) else 0 end) over (partition by {keys} order by x rows between unbounded preceding and current row)"}, {"mass": "exp(log_c + r * ln(p)) * power(1 - p, x)"})
    sums = f"(select {keys}, sum(case when x = time_in - 1 then mass end) as mass, 1 - sum(case when x < time_in - 1 then mass else 0 end) as left_over from {grid} g group by {keys})"
    on = " and ".join(f"f.{k} = m.{k}" for k in s.keys)
    joined = f"(select f.*, m.mass, m.left_over from {fit} f left join {sums} m on {on})"
    return staged(
        joined,
        {
            "hazard": f"case when runs < {LEAST_RUNS} then {UNKNOWN_HAZARD} when left_over > 1e-15 then mass / left_over end",
            "remaining": f"case when runs < {LEAST_RUNS} then {UNKNOWN_REST} when left_over > 1e-15 then greatest(0.0, r * (1 - p) / p + 1 - time_in) else 0.0 end",
            "percentile": f"case when runs < {LEAST_RUNS} then {UNKNOWN_PERCENTILE} else share end",
        },
    )


def pattern_lookup(d: Dialect, s: Series, rows: str, regimes: Sequence[int], least: int = 10) -> str:
    """Rows with the probability of a rise as it was known on their day: of their sequence and regime, else of the sequence over its regimes, else of all rows.

    rows: keys, order, sequence, regime, rose, and next_ts, the day on which `rose` was known.
    """
    day = s.order[0]
    moves = f"(select sequence, regime, next_ts as day, 1 as n, rose as rises from {rows} v where rose is not null and sequence is not null and regime is not null)"
    numbers = ", ".join(map(str, regimes))
    every = f"explode(array({numbers}))" if d.spark else f"unnest([{numbers}])"
    asks = f"(select sequence, {every} as regime, {day} as day from (select distinct sequence, {day} from {rows} w where sequence is not null) w1)"
    table = f"(select *, case when n >= {least} then rises / cast(n as double) end as p_up from {running(moves, asks, ('sequence', 'regime'), ('n', 'rises'))} t)"
    loose = f"(select sequence, day, avg(p_up) as p_up, sum(case when p_up is not null then n end) as n from {table} l group by sequence, day)"
    everything = running(f"(select next_ts as day, 1 as n, rose as rises from {rows} a1 where rose is not null)", f"(select {day} as day from {rows} a2)", (), ("n", "rises"))
    joined = f"(select r.*, t.p_up as exact_p, t.n as exact_n, u.p_up as loose_p, u.n as loose_n, b.rises / nullif(cast(b.n as double), 0) as base from {rows} r left join {table} t on r.sequence = t.sequence and r.regime = t.regime and r.{day} = t.day left join {loose} u on r.sequence = u.sequence and r.{day} = u.day left join {everything} b on r.{day} = b.day)"
    return staged(
        joined,
        {"p_up": "coalesce(exact_p, loose_p, base)", "support": "case when exact_p is not null then exact_n when loose_p is not null then loose_n else 0 end", "fallback": "case when exact_p is not null then 'none' when loose_p is not null then 'sequence_only' else 'base_rate' end"},
        {"edge": "p_up - base"},
        {"signal": "case when edge >= 0.05 then 1 when edge <= -0.05 then -1 else 0 end"},
    )


