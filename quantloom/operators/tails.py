"""Tails of distributions as column arithmetic: Student's t, F, hypergeometric and differences of Poisson counts.

Every function adds columns to a relation, in SQL for both engines.  No draws are made: a permutation of labels over a rule
leaves a hypergeometric count of hits, a resampling leaves Poisson counts, and their tails come from the counts of a rule,
in a number of terms that follows the deviation of the law, not the number of rows.
"""

from __future__ import annotations

from ..frames import Dialect, staged


def ln_gamma(z: str) -> str:
    """Logarithm of the gamma function of a positive number: Stirling's series seven steps up, to about 1e-12."""
    z = f"cast({z} as double)"
    w = f"({z} + 7)"
    product = " * ".join(f"({z} + {k})" for k in range(7))
    series = f"1 / (12 * {w}) - 1 / (360 * power({w}, 3)) + 1 / (1260 * power({w}, 5)) - 1 / (1680 * power({w}, 7))"
    return f"(({w} - 0.5) * ln({w}) - {w} + 0.9189385332046727 + {series} - ln({product}))"


def ln_choose(n: str, k: str) -> str:
    return f"({ln_gamma(f'({n} + 1)')} - {ln_gamma(f'({k} + 1)')} - {ln_gamma(f'({n} - {k} + 1)')})"


def beta(d: Dialect, source: str, name: str, x: str, a: str, b: str) -> str:
    """Adds `name`: the regularised incomplete beta function I_x(a, b), by its continued fraction, from the last term to the first.

    The fraction is taken on the side of the mean on which it converges fast; its terms grow with the root of a and b.
    """
    n = lambda k: f"{name}_{k}"
    terms = f"cast(2 * (30 + ceil(3 * sqrt(greatest({n('a')}, {n('b')})))) as int)"
    k = d.transform(d.series("1", n("terms")), "v", f"cast({n('terms')} + 1 - v as double)")
    m = "floor(k / 2)"
    even = f"{m} * ({n('q')} - {m}) * {n('y')} / (({n('p')} + 2 * {m} - 1) * ({n('p')} + 2 * {m}))"
    odd = f"-({n('p')} + {m}) * ({n('p')} + {n('q')} + {m}) * {n('y')} / (({n('p')} + 2 * {m}) * ({n('p')} + 2 * {m} + 1))"
    front = f"{n('p')} * ln({n('y')}) + {n('q')} * ln(1 - {n('y')}) + {ln_gamma(f'({n("p")} + {n("q")})')} - {ln_gamma(n('p'))} - {ln_gamma(n('q'))}"
    inside = f"{n('x')} > 0 and {n('x')} < 1"
    return staged(
        source,
        {n("x"): f"cast({x} as double)", n("a"): f"cast({a} as double)", n("b"): f"cast({b} as double)"},
        {n("flip"): f"case when {n('x')} > ({n('a')} + 1) / ({n('a')} + {n('b')} + 2) then 1 else 0 end", n("terms"): f"case when {inside} and {n('a')} > 0 and {n('b')} > 0 then {terms} end"},
        {n("y"): f"case when {inside} then case when {n('flip')} = 1 then 1 - {n('x')} else {n('x')} end end", n("p"): f"case when {n('flip')} = 1 then {n('b')} else {n('a')} end", n("q"): f"case when {n('flip')} = 1 then {n('a')} else {n('b')} end"},
        {n("part"): f"case when {n('terms')} is not null then exp({front}) / {n('p')} / {d.fold(k, '1', 'f', 'k', f'1 + case when k = 2 * {m} then {even} else {odd} end / f')} end"},
        {name: f"case when {n('x')} <= 0 then 0 when {n('x')} >= 1 then 1 when {n('flip')} = 1 then 1 - {n('part')} else {n('part')} end"},
    )


def t_tail(d: Dialect, source: str, name: str, t: str, df: str) -> str:
    """Adds `name`: the two-sided p-value of Student's t."""
    return beta(d, source, name, f"({df}) / (({df}) + ({t}) * ({t}))", f"({df}) / cast(2 as double)", "0.5")


def f_tail(d: Dialect, source: str, name: str, f: str, df1: str, df2: str) -> str:
    """Adds `name`: the upper tail of F."""
    return beta(d, source, name, f"({df2}) / (({df2}) + ({df1}) * greatest({f}, 0))", f"({df2}) / cast(2 as double)", f"({df1}) / cast(2 as double)")


def permutation_tail(d: Dialect, source: str, name: str, tp: str, fp: str, fn: str, tn: str) -> str:
    """Adds `name`: the share of all permutations of the labels in which the rule has at least `tp` of its hits on label 1.

    That many more true than false alarms, too, as the rule's hits stay.  Terms beyond forty deviations are zero in doubles.
    """
    n = lambda k: f"{name}_{k}"
    count = lambda x: f"cast({x} as double)"
    rows = staged(
        source,
        {n("hit"): f"{count(tp)} + {fp}", n("pos"): f"{count(tp)} + {fn}", n("all"): f"{count(tp)} + {fp} + {fn} + {tn}", n("tp"): count(tp)},
        {n("mean"): f"case when {n('all')} > 0 then {n('hit')} * {n('pos')} / {n('all')} end"},
        {n("dev"): f"sqrt({n('mean')} * (1 - {n('pos')} / {n('all')}) + 1)", n("least"): f"greatest(0, {n('hit')} + {n('pos')} - {n('all')})", n("most"): f"least({n('hit')}, {n('pos')})", n("up"): f"case when {n('tp')} > {n('mean')} then 1 else 0 end"},
        {n("from"): f"cast(case when {n('up')} = 1 then {n('tp')} else greatest({n('least')}, floor({n('tp')} - 1 - 40 * {n('dev')})) end as bigint)", n("to"): f"cast(case when {n('up')} = 1 then least({n('most')}, ceil({n('tp')} + 40 * {n('dev')})) else {n('tp')} - 1 end as bigint)"},
    )
    mass = f"exp({ln_choose(n('pos'), 'k')} + {ln_choose(f'({n("all")} - {n("pos")})', f'({n("hit")} - k)')} - {ln_choose(n('all'), n('hit'))})"
    total = f"case when {n('from')} > {n('to')} then 0 else {d.total(d.transform(d.series(n('from'), n('to')), 'k', mass))} end"
    return staged(rows, {n("sum"): f"case when {n('mean')} is not null then {total} end"}, {name: f"case when {n('up')} = 1 then least(1, {n('sum')}) else greatest(0, 1 - {n('sum')}) end"})


def resampled_tail(d: Dialect, source: str, keys: str, tp: str = "tp", fp: str = "fp") -> str:
    """(keys, p_below): how often a resampling leaves no more true than false alarms.

    Resampled counts are Poisson counts of the rule's own; one row for each count within ten deviations of either.
    """
    lo = "greatest(0, least({a} - 10 * sqrt({a}) - 20, {b} - 10 * sqrt({b}) - 20))"
    hi = "{b} + 10 * sqrt({b}) + 20"
    put = lambda x: x.format(a="a_", b="b_")
    rows = f"(select {keys}, cast({tp} as double) as a_, cast({fp} as double) as b_ from {source} r0)"
    grid = f"(select *, {d.explode(d.series(f'cast(floor({put(lo)}) as bigint)', f'cast(ceil({put(hi)}) as bigint)'), 'k')} from {rows} r1)"
    mass = lambda m: f"case when {m} > 0 then exp(k * ln(nullif({m}, 0)) - {m} - {ln_gamma('(k + cast(1 as double))')}) when k = 0 then 1 else 0 end"
    summed = staged(grid, {"mass_a": mass("a_"), "mass_b": mass("b_")}, {"upto": f"sum(mass_a) over (partition by {keys} order by k rows between unbounded preceding and current row)"})
    return f"(select {keys}, least(1, sum(mass_b * upto)) as p_below from {summed} g group by {keys})"


def resampled_quantile(d: Dialect, source: str, keys: str, share: float = 0.05, tp: str = "tp", fp: str = "fp", reach: int = 12) -> str:
    """(keys, low): the least difference of true and false alarms that at least `share` of resamplings stay below or at.

    It lies within `reach` of what a normal law says, whatever the counts; the distribution is summed at those values only.
    """
    rows = f"(select {keys}, cast({tp} as double) as a_, cast({fp} as double) as b_ from {source} r0)"
    z = {0.05: -1.6448536269514722, 0.5: 0.0, 0.95: 1.6448536269514722}[share]
    bounds = staged(rows, {"lo_": "cast(floor(greatest(0, least(a_ - 10 * sqrt(a_) - 20, b_ - 10 * sqrt(b_) - 20))) as bigint)", "hi_": "cast(ceil(greatest(a_ + 10 * sqrt(a_), b_ + 10 * sqrt(b_)) + 20) as bigint)", "c_": f"cast(floor(a_ - b_ + {z} * sqrt(a_ + b_)) as bigint)"})
    grid = f"(select *, {d.explode(d.series('lo_', 'hi_'), 'k')} from {bounds} r1)"
    mass = lambda m: f"case when {m} > 0 then exp(k * ln(nullif({m}, 0)) - {m} - {ln_gamma('(k + cast(1 as double))')}) when k = 0 then 1 else 0 end"
    own = ", ".join(keys.split(", "))
    summed = staged(grid, {"mass_a": mass("a_"), "mass_b": mass("b_")}, {"upto": f"sum(mass_a) over (partition by {own} order by k rows between unbounded preceding and current row)"})
    shifted = f"(select *, {d.explode(d.series(f'c_ - {reach}', f'c_ + {reach}'), 'c')} from {summed} s1 where mass_b > 1e-18)"
    on = " and ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    named = ", ".join(f"y.{k}" for k in keys.split(", "))
    law = f"(select {named}, y.c, sum(y.mass_b * case when y.k + y.c > y.hi_ then 1 else coalesce(x.upto, 0) end) as below from {shifted} y left join {summed} x on {on} and x.k = y.k + y.c group by {named}, y.c)"
    return f"(select {keys}, min(case when below >= {share} then c end) as low from {law} w group by {keys})"
