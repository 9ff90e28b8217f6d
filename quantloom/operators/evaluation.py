"""Evaluating strategies, rules and trades: significance, searches over thresholds, paths and portfolios."""

from __future__ import annotations

from collections.abc import Sequence

from ..frames import Dialect, Series, staged
from . import tails
from .flow import normal_cdf

ONE = "cast(1 as double)"


def two_sided(z: str) -> str:
    """Two-sided normal p-value of a statistic."""
    return f"2 * (1 - ({normal_cdf(f'abs({z})')}))"


def mixed(*parts: str) -> str:
    """A pseudo-random whole number below 2^31 - 1 from whole numbers, alike in every engine."""
    factors = (1103515245, 1299709, 7919, 104729)
    total = " + ".join(f"(cast({p} as bigint) % 1000003) * {f}" for p, f in zip(parts, factors, strict=False))
    once = f"(({total}) % 2147483647)"
    return f"(({once} % 65536) * 48271 + {once} * 31 + 12345) % 2147483647"


def unpivot(source: str, keys: Sequence[str], features: Sequence[str]) -> str:
    """A row for each feature: the keys, feature and value."""
    return "(" + " union all ".join(f"select {', '.join(keys)}, '{f}' as feature, cast({f} as double) as value from {source} u{k}" for k, f in enumerate(features)) + ")"


def rule_counts(source: str, key: str = "symbol") -> str:
    """True and false alarms and misses of a rule by key.  source: key, hit and label (0 or 1)."""
    count = lambda h, y: f"sum(case when hit = {h} and label = {y} then 1 else 0 end)"
    return f"(select {key}, {count(1, 1)} as tp, {count(1, 0)} as fp, {count(0, 1)} as fn, {count(0, 0)} as tn from {source} s where hit is not null and label is not null group by {key})"


def permutation_test(d: Dialect, source: str, key: str = "symbol") -> str:
    """Share of all permutations of the labels in which the rule has as many true over false alarms as it has, and what they have on average.

    source: key, hit and label (0 or 1).
    """
    rows = tails.permutation_tail(d, rule_counts(source, key), "p_value", "tp", "fp", "fn", "tn")
    return staged(rows, {"observed": "tp - fp", "n": "tp + fp + fn + tn", "expected": f"{ONE} * (tp + fp) * (tp + fn - fp - tn) / (tp + fp + fn + tn)"})


def bootstrap(d: Dialect, source: str, key: str = "symbol") -> str:
    """Of resampled true over false alarms: the fifth percentile, the median, the deviation, and how often they aren't above zero.  source: as above."""
    counts = rule_counts(source, key)
    parts = [tails.resampled_quantile(d, counts, key, 0.05), tails.resampled_quantile(d, counts, key, 0.5), tails.resampled_tail(d, counts, key)]
    return f"(select c.{key}, c.tp, c.fp, sqrt({ONE} * (c.tp + c.fp)) as spread, l.low, m.low as middle, b.p_below from {counts} c join {parts[0]} l on c.{key} = l.{key} join {parts[1]} m on c.{key} = m.{key} join {parts[2]} b on c.{key} = b.{key})"


PERCENTILES = tuple(range(10, 100, 10))


#: Buckets of a group's range, among which its percentiles are sought.
BUCKETS = 4096


def sorted_quantiles(long: str, by: Sequence[str], pcts: Sequence[int]) -> str:
    """Exact percentiles (by, pct, threshold) of each group's values, without one task that holds or sorts a group.

    Values are counted by buckets of the group's range; only the buckets in which a percentile lies are looked into.
    """
    same = lambda a, b, *more: " and ".join(f"{a}.{k} = {b}.{k}" for k in (*by, *more))
    of = lambda a: ", ".join(f"{a}.{k}" for k in by)
    keys = ", ".join(by)
    rows = f"(select {keys}, value from {long} l0 where value is not null)"
    shape = f"(select {keys}, count(*) as n, min(value) as lo, max(value) as hi from {rows} r group by {keys})"
    bucket = f"case when hi > lo then coalesce(least({BUCKETS - 1}, try_cast((value - lo) / (hi - lo) * {BUCKETS} as int)), {BUCKETS - 1}) else 0 end"
    dealt = f"(select /*+ broadcast(s) */ {of('r')}, r.value, {bucket} as bucket from {rows} r join {shape} s on {same('r', 's')})"
    upto = lambda source, part, order: f"(select *, sum(c) over (partition by {part} order by {order} rows between unbounded preceding and current row) as upto from {source} q)"
    filled = upto(f"(select {keys}, bucket, count(*) as c from {dealt} d group by {keys}, bucket)", keys, "bucket")
    at = f"(select *, (n - 1) * (pct / 100D) as at from (select {keys}, n, explode(array({', '.join(map(str, pcts))})) as pct from {shape} s) p)"
    wanted = f"(select {keys}, pct, at, explode(array(cast(floor(at) as bigint), cast(ceil(at) as bigint))) as place from {at} a)"
    places = f"(select distinct {of('w')}, w.pct, w.at, w.place, f.bucket, f.upto - f.c as before from {wanted} w join {filled} f on {same('w', 'f')} and w.place < f.upto and w.place >= f.upto - f.c)"
    inside = f"(select /*+ broadcast(n) */ {of('d')}, d.bucket, d.value, count(*) as c from {dealt} d join (select distinct {keys}, bucket from {places} p) n on {same('d', 'n', 'bucket')} group by {of('d')}, d.bucket, d.value)"
    found = f"(select {of('p')}, p.pct, p.at, p.place, v.value from {places} p join {upto(inside, f'{keys}, bucket', 'value')} v on {same('p', 'v', 'bucket')} and p.place - p.before < v.upto and p.place - p.before >= v.upto - v.c)"
    return f"(select {keys}, pct, min(value) + (max(value) - min(value)) * (max(at) - floor(max(at))) as threshold from {found} f group by {keys}, pct)"


def thresholds(d: Dialect, long: str, by: Sequence[str]) -> str:
    """Percentiles of each feature's values, a row each: by, pct, threshold."""
    if d.spark:
        return sorted_quantiles(long, by, PERCENTILES)
    keys = ", ".join(by)
    each = " union all ".join(f"select {keys}, {p} as pct, {d.quantile('value', p / 100)} as threshold from {long} t{p} where value is not null group by {keys}" for p in PERCENTILES)
    return f"({each})"


def confusion(d: Dialect, long: str, limits: str, by: Sequence[str]) -> str:
    """Counts of rule and label for each feature, percentile and direction.  long: by, value, label (0 or 1)."""
    on = " and ".join(f"l.{b} = t.{b}" for b in by)
    keys = ", ".join(f"l.{b}" for b in by)
    plain = ", ".join(by)
    if d.spark:  # rows of one label between the same limits are counted first; a limit is below a value with more lower limits than it has itself
        lines = f"(select {plain}, array_agg(threshold) as ts from {limits} t0 group by {plain})"
        cells = f"(select {keys}, l.label, size(filter(t.ts, x -> x < l.value)) as under, size(filter(t.ts, x -> x <= l.value)) as upto from {long} l join {lines} t on {on} where l.value is not null)"
        cells = f"(select {plain}, label, under, upto, count(*) as m from {cells} c group by {plain}, label, under, upto)"
        ranked = f"(select *, size(filter(array_agg(threshold) over (partition by {plain}), x -> x < threshold)) as lower from {limits} t1)"
        both = f"(select {keys}, t.pct, t.threshold, v.direction, l.label, l.m, case when v.direction = 'below' then l.under <= t.lower else l.upto > t.lower end as hit from {cells} l join {ranked} t on {on} cross join (select 'below' as direction union all select 'above') v)"
        count = lambda h, y: f"sum(case when {h} and label = {y} then m else 0 end)"
        return f"(select {plain}, pct, direction, min(threshold) as threshold, {count('hit', 1)} as tp, {count('hit', 0)} as fp, {count('not hit', 1)} as fn, {count('not hit', 0)} as tn from {both} b group by {plain}, pct, direction)"
    hit = "case when direction = 'below' then case when value <= threshold then 1 else 0 end else case when value >= threshold then 1 else 0 end end"
    both = f"(select {keys}, l.value, l.label, t.pct, t.threshold, v.direction from {long} l join {limits} t on {on} cross join (select 'below' as direction union all select 'above') v where l.value is not null)"
    count = lambda h, y: f"sum(case when hit = {h} and label = {y} then 1 else 0 end)"
    return f"(select {plain}, pct, direction, min(threshold) as threshold, {count(1, 1)} as tp, {count(1, 0)} as fp, {count(0, 1)} as fn, {count(0, 0)} as tn from (select *, {hit} as hit from {both} b) h group by {plain}, pct, direction)"


def rule_search(d: Dialect, source: str, features: Sequence[str], net: float = 0.1) -> str:
    """Rules of one feature, percentile and direction with seven gates.  source: i, year_, label, and the features.

    G1 more true than false alarms; G2 a net benefit; G3 the first in every year of five rows or more, by the year's own
    percentile; G4 neighbouring percentiles have the same sign; G5 fewer than a twentieth of all resamplings leave no
    benefit; G6 fewer than a twentieth of all permutations of the labels do as well; G7 ten rows of either label.  G5 and
    G6 come from the rules' counts; G5 is asked of those rules only that pass G1, G2, G4 and G7.
    """
    return rule_tests(d, rule_gates(d, source, features, net))


def rule_gates(d: Dialect, source: str, features: Sequence[str], net: float = 0.1) -> str:
    """Rules with the gates that counts decide.  source: as for rule_search."""
    long = unpivot(source, ("i", "year_", "label"), features)
    rules = confusion(d, long, thresholds(d, long, ("feature",)), ("feature",))
    yearly = confusion(d, long, thresholds(d, long, ("feature", "year_")), ("feature", "year_"))
    years = f"(select feature, pct, direction, min(case when tp + fp + fn + tn >= 5 then case when tp >= fp then 1 else 0 end else 1 end) as g3 from {yearly} y group by feature, pct, direction)"
    over = "over (partition by feature, direction order by pct)"
    near = staged(rules, {"gain": "tp - fp"}, {"before": f"lag(sign(gain)) {over}", "after": f"lead(sign(gain)) {over}"})
    return f"""(select r.*, y.g3, case when tp >= fp then 1 else 0 end as g1, case when tp + fp > 0 and cast(gain as double) / nullif(tp + fp, 0) >= {net} then 1 else 0 end as g2,
      case when coalesce(before, sign(gain)) = sign(gain) and coalesce(after, sign(gain)) = sign(gain) then 1 else 0 end as g4, case when tp + fn >= 10 and fp + tn >= 10 then 1 else 0 end as g7
      from {near} r join {years} y on r.feature = y.feature and r.pct = y.pct and r.direction = y.direction)"""


def rule_tests(d: Dialect, gates: str) -> str:
    """The rules of rule_gates with the gates of tests, and how many they pass."""
    tested = tails.permutation_tail(d, gates, "p_value", "tp", "fp", "fn", "tn")
    rule = "feature, pct, direction"
    passed = f"(select {rule}, tp, fp from {gates} g where g1 = 1 and g2 = 1 and g4 = 1 and g7 = 1)"
    low = tails.resampled_tail(d, passed, rule)
    joined = f"(select g.*, l.p_below from {tested} g left join {low} l on g.feature = l.feature and g.pct = l.pct and g.direction = l.direction)"
    return staged(joined, {"g5": "case when p_below < 0.05 then 1 else 0 end", "g6": "case when p_value < 0.05 then 1 else 0 end"}, {"gates": "g1 + g2 + g3 + g4 + g5 + g6 + g7"})


def group_tests(d: Dialect, source: str, keys: Sequence[str], features: Sequence[str], least: int = 5) -> str:
    """t, p and effect size of each feature between winners and losers.  source: keys, winner (0 or 1), the features."""
    k = ", ".join(keys)
    long = unpivot(source, (*keys, "winner"), features)
    side = lambda f, w: f"{f}(case when winner = {w} then value end)"
    base = f"(select {k}, feature, {side('count', 1)} as n1, {side('count', 0)} as n0, {side('avg', 1)} as m1, {side('avg', 0)} as m0, {side('var_samp', 1)} as v1, {side('var_samp', 0)} as v0 from {long} l group by {k}, feature)"
    rows = staged(
        f"(select * from {base} b where n1 >= {least} and n0 >= {least})",
        {"pooled": "((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)", "tests": f"count(*) over (partition by {k})"},
        {"t": "(m1 - m0) / nullif(sqrt(pooled * (cast(1 as double) / n1 + cast(1 as double) / n0)), 0)", "effect": "(m1 - m0) / nullif(sqrt(pooled), 0)"},
    )
    return staged(
        tails.t_tail(d, rows, "p", "t", "n1 + n0 - 2"),
        {"significant": "case when p < 0.05 / tests and abs(effect) > 0.3 then 1 else 0 end", "rank_": f"row_number() over (partition by {k} order by round(abs(effect), 9) desc, feature)"},
    )


def welch(d: Dialect, source: str, name: str, a: str, b: str) -> str:
    """Adds `name`, its degrees of freedom and its p-value: Welch's t of two groups.  a, b: prefixes of columns n, mean and var."""
    se = lambda x: f"{x}_var / {x}_n"
    rows = staged(
        source,
        {f"{name}_se": f"{se(a)} + {se(b)}"},
        {name: f"({a}_mean - {b}_mean) / nullif(sqrt({name}_se), 0)", f"{name}_df": f"{name}_se * {name}_se / nullif(power({se(a)}, 2) / ({a}_n - 1) + power({se(b)}, 2) / ({b}_n - 1), 0)"},
    )
    return tails.t_tail(d, rows, f"{name}_p", name, f"{name}_df")


LEVELS = tuple(range(20, 81, 5))


def threshold_search(d: Dialect, source: str, key: str = "symbol", least: int = 20, factor: float = 0.5) -> str:
    """Each percentile of x as a threshold of y's mean: Welch's t of the rows above against the rest, and the best one in either direction.

    source: key, x, y.  Rows are counted once, into the bins between thresholds; the sides of a threshold are sums of bins.
    `best_above` and `best_below` mark a key's least p-value where the mean is higher above, or at and below; `exit_level` is
    the threshold scaled by 1 - `factor`.  Sides of fewer than `least` rows count for nothing.
    """
    rows = f"(select {key}, cast(x as double) as x, cast(y as double) as y from {source} s where x is not null and y is not null)"
    cuts = f"(select {key}, {', '.join(f'{d.quantile("x", p / 100)} as c{p}' for p in LEVELS)}, avg(y) as centre from {rows} q group by {key})"
    bins = f"(select r.{key}, {' + '.join(f'case when r.x > c.c{p} then 1 else 0 end' for p in LEVELS)} as bin, r.y - c.centre as y from {rows} r join {cuts} c on r.{key} = c.{key})"
    sums = f"(select {key}, bin, count(*) as n, sum(y) as s, sum(y * y) as ss from {bins} b group by {key}, bin)"
    levels = " union all ".join(f"select {key}, {p} as p, {k} as bin, c{p} as threshold, centre from {cuts} l{p}" for k, p in enumerate(LEVELS))
    side = lambda x, test: f"sum(case when m.bin {test} l.bin then m.{x} else 0 end)"
    sides = f"(select l.{key}, l.p, l.threshold, l.centre, {', '.join(f'{side(x, t)} as {g}_{x}' for g, t in (('high', '>'), ('low', '<=')) for x in ('n', 's', 'ss'))} from ({levels}) l join {sums} m on l.{key} = m.{key} group by l.{key}, l.p, l.threshold, l.centre)"
    stats = staged(f"(select * from {sides} z where high_n >= {least} and low_n >= {least})", {f"{g}_mean": f"{g}_s / {g}_n" for g in ("high", "low")} | {f"{g}_var": f"greatest({g}_ss - {g}_s * {g}_s / {g}_n, 0) / ({g}_n - 1)" for g in ("high", "low")})
    tested = welch(d, stats, "t", "high", "low")
    first = lambda sign: f"case when t {sign} 0 and row_number() over (partition by {key}, sign(t) order by round(t_p, 12), p) = 1 then 1 else 0 end"
    return staged(tested, {"best_above": first(">"), "best_below": first("<"), "exit_level": f"threshold * {1 - factor}", "high_average": "high_mean + centre", "low_average": "low_mean + centre"})


def mutual_information(source: str, features: Sequence[str], bins: int = 10) -> str:
    """Mutual information, in bits, of each feature in equal-count bins with a target.  source: i, target, the features."""
    long = unpivot(source, ("i", "target"), features)
    binned = f"(select feature, target, ntile({bins}) over (partition by feature order by round(value, 9), i) as bin from {long} l where value is not null and target is not null)"
    counts = f"(select feature, target, bin, cast(count(*) as double) as c from {binned} b group by feature, target, bin)"
    by = lambda *c: f"sum(c) over (partition by {', '.join(('feature', *c))})"
    shares = staged(counts, {"n": by(), "nt": by("target"), "nb": by("bin")})
    return f"(select feature, max(n) as n, sum(c / n * log2(c * n / (nt * nb))) as bits from {shares} s group by feature)"


def convexity(d: Dialect, s: Series, source: str) -> str:
    """0.3 of the corrected skewness and 0.7 of the ratio of means in lively and quiet times, held to 0 .. 2.  source: r."""
    keys = ", ".join(s.keys)
    rows = staged(source, {"vol": s.roll("stddev_samp", "r", 20)})
    middle = f"(select {keys}, {d.quantile('vol', 0.5)} as middle from {rows} v where vol is not null group by {keys})"
    base = f"(select r.{s.keys[0]}, count(r.r) as n, avg(r.r) as m1, avg(r.r * r.r) as m2, avg(r.r * r.r * r.r) as m3, avg(case when r.vol > m.middle then r.r end) as lively, avg(case when r.vol <= m.middle then r.r end) as quiet from {rows} r join {middle} m on r.{s.keys[0]} = m.{s.keys[0]} where r.r is not null group by r.{s.keys[0]})"
    return staged(
        base,
        {"c2": "m2 - m1 * m1", "c3": "m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1"},
        {"skew": "sqrt(n * (n - 1.0)) / (n - 2) * c3 / nullif(power(c2, 1.5), 0)", "ratio": "coalesce(lively / nullif(quiet, 0), 1)"},
        {"convexity": "case when n < 30 then 0 else greatest(0, least(2.0, 0.3 * skew + 0.7 * ratio)) end"},
    )


def contribution(pairs: str) -> str:
    """How much a series adds to the others: mean correlation, profit while they lose, and a multiplier.

    pairs: a, b, ts, ra, rb, with both orders of each pair.
    """
    corr = f"(select a, avg(c) as mean_corr from (select a, b, corr(ra, rb) as c from {pairs} p group by a, b having count(*) > 20) x group by a)"
    book = f"(select a, ts, min(ra) as ra, avg(rb) as book from {pairs} q group by a, ts)"
    crisis = f"(select a, case when count(*) > 10 then avg(ra) / nullif(abs(avg(book)), 0) else 0 end as alpha from {book} b where book < 0 group by a)"
    joined = f"(select c.a, c.mean_corr, coalesce(k.alpha, 0) as alpha from {corr} c left join {crisis} k on c.a = k.a)"
    return staged(joined, {"multiplier": "case when mean_corr < -0.3 and alpha > 0.5 then 5.0 when mean_corr < 0 then 2.0 + abs(mean_corr) * 3.0 when mean_corr < 0.3 then 1.0 + (0.3 - mean_corr) when mean_corr < 0.7 then 1.0 - (mean_corr - 0.3) * 0.5 else 0.1 end"})


def fitness(source: str) -> str:
    """Weighted, capped ratios less penalties for deep drawdowns and few trades.  source: the columns of a performance table, trades."""
    return staged(
        source,
        {"weighted": "0.4 * least(sharpe, 5.0) + 0.2 * least(sortino, 5.0) + 0.2 * least(calmar, 5.0) + 0.1 * (win_rate - 0.5) * 2 + 0.1 * least(profit_factor - 1.0, 3.0)"},
        {"fitness": "weighted - case when -max_dd > 0.3 then 0.5 * (-max_dd - 0.3) else 0 end - case when trades < 10 then 0.3 * (10 - trades) / 10 else 0 end"},
    )


#: Legs of option structures as right, quantity, distance of the strike from spot, and the multiple of the term.
STRUCTURES = {
    "long_call": (("C", 1, 0.03, 1),),
    "short_put": (("P", -1, -0.03, 1),),
    "long_straddle": (("C", 1, 0.0, 1), ("P", 1, 0.0, 1)),
    "short_strangle": (("C", -1, 0.03, 1), ("P", -1, -0.03, 1)),
    "call_debit_spread": (("C", 1, 0.0, 1), ("C", -1, 0.05, 1)),
    "put_credit_spread": (("P", 1, -0.05, 1), ("P", -1, 0.0, 1)),
    "iron_condor": (("C", -1, 0.05, 1), ("P", -1, -0.05, 1), ("C", 1, 0.10, 1), ("P", 1, -0.10, 1)),
    "iron_butterfly": (("C", -1, 0.0, 1), ("P", -1, 0.0, 1), ("C", 1, 0.05, 1), ("P", 1, -0.05, 1)),
    "call_calendar": (("C", -1, 0.0, 1), ("C", 1, 0.0, 2)),
}


def build_legs(entries: str, term: int = 30, structures: Sequence[str] = tuple(STRUCTURES)) -> str:
    """A row for each leg of each structure at each entry: right, quantity, strike and days.  entries: symbol, ts, spot."""
    rows = [(name, k, *leg) for name in structures for k, leg in enumerate(STRUCTURES[name], 1)]
    table = " union all ".join(f"select '{n}' as structure, {k} as leg, '{o}' as opt, {q} as qty, cast({m} as double) as away, {t * term} as dte" for n, k, o, q, m, t in rows)
    return f"(select e.symbol, e.ts, e.spot, t.structure, t.leg, t.opt, t.qty, t.dte, floor(e.spot * (1 + t.away) + 0.5) as strike, cast(0.2 + 0.5 * abs(t.away) as double) as iv from {entries} e cross join ({table}) t)"


def attribution(s: Series, source: str) -> str:
    """Parts of a price change by averages of consecutive Greeks.  source: ts, spot, iv, price, delta, gamma, theta, vega, days."""
    mean = lambda g: f"({g} + {s.lag(g)}) / 2"
    return staged(
        source,
        {"d_spot": f"spot - {s.lag('spot')}", "d_iv": f"iv - {s.lag('iv')}", "d_days": f"days - {s.lag('days')}", "d_price": f"price - {s.lag('price')}", **{f"mean_{g}": mean(g) for g in ("delta", "gamma", "theta", "vega")}},
        {"delta_part": "mean_delta * d_spot", "gamma_part": "0.5 * mean_gamma * d_spot * d_spot", "theta_part": "mean_theta * d_days", "vega_part": "mean_vega * d_iv * 100"},
        {"explained": "delta_part + gamma_part + theta_part + vega_part"},
    )
