"""Entropy, divergence and regression measures of series, as relations that both engines can run.

A histogram has equal bins from the frame's smallest to its largest value; the last bin is closed.  Entropies are of the
bins' shares.  Frames are bounded, so a row's work doesn't grow with the history.
"""

from __future__ import annotations

from ..frames import Dialect, Series, staged

#: Added to a bin of the second distribution, or of both, so that no logarithm meets a zero.
TINY = "1e-10"


def bin_of(v: str, low: str, width: str, bins: int) -> str:
    """Number of the bin of v, from 0."""
    return f"least({bins - 1}, cast(floor(({v} - {low}) / {width} * {bins}) as int))"


def bin_counts(d: Dialect, codes: str, bins: int) -> str:
    """How many of the codes fall in each bin, as a list of doubles."""
    inside = d.size(d.filter(codes, "c", "c = b"))
    return d.transform(d.series("0", str(bins - 1)), "b", f"cast({inside} as double)")


def entropy_of(d: Dialect, counts: str, n: str, log: str) -> str:
    """Entropy of a list of counts that sum to n."""
    return d.total(d.transform(d.filter(counts, "c", "c > 0"), "c", f"-(c / {n}) * {log}(c / {n})"))


def rolling_entropy(s: Series, source: str, x: str = "r", window: int = 50, bins: int = 20, past: bool = False, log: str = "log2", name: str = "entropy") -> str:
    """Entropy of the last `window` values, this row's included unless `past`; null until the frame is full."""
    d, frame = s.d, s.P(window) if past else s.R(window)
    return staged(
        source,
        {"seen_": f"count({x}) {frame}", "low_": f"min({x}) {frame}", "width_": f"max({x}) {frame} - min({x}) {frame}", "values_": f"{d.collect(x)} {frame}"},
        {"codes_": f"case when seen_ = {window} then {d.transform('values_', 'v', f'case when width_ > 0 then {bin_of("v", "low_", "width_", bins)} else 0 end')} end"},
        {"counts_": f"case when seen_ = {window} then {bin_counts(d, 'codes_', bins)} end"},
        {name: f"case when seen_ = {window} then {entropy_of(d, 'counts_', f'{window}', log)} end"},
    )


def entropy_decay(s: Series, source: str, smooth: int = 5, **params) -> str:
    """Change of the entropy over some rows, a row."""
    return staged(rolling_entropy(s, source, **params), {"decay": f"(entropy - {s.lag('entropy', smooth)}) / {smooth}"})


def entropy_dynamics(s: Series, source: str, x: str = "r", window: int = 20, bins: int = 20) -> str:
    """Natural entropy of the rows before, its velocity and acceleration backwards in time, and whether it decays."""
    return staged(
        rolling_entropy(s, source, x, window, bins, past=True, log="ln"),
        {"velocity": f"entropy - {s.lag('entropy')}"},
        {"acceleration": f"velocity - {s.lag('velocity')}", "decaying": "case when velocity < -0.01 then 1 else 0 end"},
    )


def entropy_equilibrium(s: Series, source: str, recent: int = 50, **params) -> str:
    """Mean entropy so far, the distance from it, and the rate at which the recent distance falls, with its half-life; null where it hardly falls."""
    rows = staged(entropy_dynamics(s, source, **params), {"level": f"avg(entropy) {s.U}", "row_": f"cast(row_number() {s.W} as double)"})
    return staged(
        rows,
        {"distance": "entropy - level"},
        {"log_distance": f"ln(abs(distance) + {TINY})"},
        {"slope": f"case when count(log_distance) {s.R(recent)} = {recent} then covar_pop(log_distance, row_) {s.R(recent)} / nullif(var_pop(row_) {s.R(recent)}, 0) end"},
        {"decay_rate": "-slope", "half_life": "case when slope < -0.001 then ln(2.0) / -slope end"},
    )


def _shares(d: Dialect, counts: str, n: str, smooth: str, bins: int) -> str:
    """A list of counts as shares after `smooth` is added to each bin."""
    return d.transform(counts, "c", f"(c + {smooth}) / ({n} + {bins} * {smooth})")


def _divergence(d: Dialect, p: str, q: str, bins: int) -> str:
    """Kullback-Leibler divergence of two lists of shares, over the bins where p is above 0."""
    at = lambda a: f"{a}[b]" if d.spark else f"{a}[b + 1]"
    return f"greatest(0, {d.total(d.transform(d.series('0', str(bins - 1)), 'b', f'case when {at(p)} > 0 then {at(p)} * ln({at(p)} / {at(q)}) else 0.0 end'))})"


def rolling_divergence(s: Series, source: str, x: str = "r", baseline: int = 252, current: int = 20, bins: int = 20) -> str:
    """Divergence of the last rows from the rows before them over common bins, one way and symmetric."""
    d = s.d
    before = s._over(f" rows between {baseline + current - 1} preceding and {current} preceding")
    whole, now = s.R(baseline + current), s.R(current)
    code = lambda a: d.transform(a, "v", f"case when range_ > 0 then {bin_of('v', 'least_', 'range_', bins)} else 0 end")
    full = f"all_ = {baseline + current}"
    only = lambda e: f"case when {full} then {e} end"
    return staged(
        source,
        {"all_": f"count({x}) {whole}", "least_": f"min({x}) {whole}", "range_": f"max({x}) {whole} - min({x}) {whole}", "now_": f"{d.collect(x)} {now}", "base_": f"{d.collect(x)} {before}"},
        {"now_codes": only(code("now_")), "base_codes": only(code("base_"))},
        {"now_counts": only(bin_counts(d, "now_codes", bins)), "base_counts": only(bin_counts(d, "base_codes", bins))},
        {"p": only(_shares(d, "now_counts", str(current), "0.0", bins)), "q": only(_shares(d, "base_counts", str(baseline), TINY, bins)), "p_smooth": only(_shares(d, "now_counts", str(current), TINY, bins)), "q_plain": only(_shares(d, "base_counts", str(baseline), "0.0", bins))},
        {"kl": only(_divergence(d, "p", "q", bins))},
        {"kl_both": only(f"0.5 * (kl + {_divergence(d, 'q_plain', 'p_smooth', bins)})")},
    )


def pair_divergence(d: Dialect, pairs: str, returns: str, bins: int = 50) -> str:
    """Jensen-Shannon divergence of the values of two keys over common bins, between 0 and 1.

    pairs: a, b.  returns: symbol, r.  Counts are grouped sums; both histograms of a pair are joined by bin.
    """
    range_ = f"(select symbol, min(r) as low, max(r) as high from {returns} x where r is not null group by symbol)"
    edges = f"(select p.a, p.b, least(m.low, n.low) as low, greatest(m.high, n.high) - least(m.low, n.low) as width from {pairs} p join {range_} m on p.a = m.symbol join {range_} n on p.b = n.symbol)"
    side = lambda key, k: f"select e.a, e.b, {k} as side, {bin_of('x.r', 'e.low', 'e.width', bins)} as bin from {edges} e join {returns} x on x.symbol = e.{key} where x.r is not null and e.width > 0"
    counts = f"(select a, b, bin, cast(count(case when side = 0 then 1 end) as double) as p, cast(count(case when side = 1 then 1 end) as double) as q from ({side('a', 0)} union all {side('b', 1)}) u group by a, b, bin)"
    over = "over (partition by a, b)"
    shares = staged(counts, {"n_p": f"sum(p) {over}", "n_q": f"sum(q) {over}"}, {"sp": f"(p + {TINY} * n_p) / n_p", "sq": f"(q + {TINY} * n_q) / n_q"}, {"mid": "0.5 * (sp + sq)"})
    return f"(select a, b, sum(0.5 * sp * ln(sp / mid) + 0.5 * sq * ln(sq / mid)) / ln(2.0) as js from {shares} t group by a, b)"


def _last_five(s: Series, x: str, weights: tuple[float, ...], divisor: float) -> str:
    """Weighted sum of the last five rows, the oldest first."""
    terms = " + ".join(f"({w} * {s.lag(x, 4 - k)})" if k < 4 else f"({w} * {x})" for k, w in enumerate(weights))
    return f"case when count({x}) {s.R(5)} = 5 then ({terms}) / {divisor} end"


def smooth_slope(s: Series, x: str) -> str:
    """Slope at this row of the parabola through the last five rows by least squares."""
    return _last_five(s, x, (26, -27, -40, -13, 54), 70.0)


def smooth_curve(s: Series, x: str) -> str:
    """Second derivative of that parabola."""
    return _last_five(s, x, (2, -1, -2, -1, 2), 7.0)


def derivative_estimates(s: Series, source: str, x: str = "close") -> str:
    """Velocity, acceleration, jerk and snap of a series from trailing parabolas, inflections, and how likely a turn is.

    A turn is likely when the velocity is small against what the acceleration takes from it in a few rows.
    """
    return staged(
        source,
        {"velocity": smooth_slope(s, x), "acceleration": smooth_curve(s, x)},
        {"jerk": smooth_slope(s, "acceleration"), "snap": smooth_curve(s, "acceleration"), "inflection": f"case when sign(acceleration) * sign({s.lag('acceleration')}) < 0 then 1 else 0 end"},
        {"reversal": "case when velocity * acceleration < 0 then 1 - exp(-abs(acceleration) / greatest(abs(velocity), 1e-10)) when velocity is not null then 0 end"},
    )


def shape_velocity(s: Series, source: str) -> str:
    """Speed at which rolling skewness and kurtosis change, the probability that the shape turns, and its direction."""
    return staged(
        source,
        {"skew_velocity": smooth_slope(s, "skew"), "kurtosis_velocity": smooth_slope(s, "kurtosis")},
        {"speed": "sqrt(skew_velocity * skew_velocity + kurtosis_velocity * kurtosis_velocity)"},
        {"transition": "1 - exp(-5 * speed)", "direction": "case when skew_velocity is null then 'unknown' when skew_velocity < -0.1 then 'becoming_P' when skew_velocity > 0.1 then 'becoming_B' else 'stable' end"},
    )


def cholesky(names: list[list[str]], right: list[str], prefix: str) -> tuple[list[dict[str, str]], str]:
    """Stages that factor a symmetric matrix of columns, and the explained sum b' A^-1 b, by columns.

    The matrix is small and written out, so that thousands of groups are solved in one projection.
    """
    n, stages = len(right), []
    for j in range(n):
        diagonal = " - ".join([names[j][j], *(f"power({prefix}l{j}_{k}, 2)" for k in range(j))])
        stages.append({f"{prefix}l{j}_{j}": f"sqrt(greatest({diagonal}, 1e-18))"})
        below = {}
        for i in range(j + 1, n):
            dot = " - ".join([names[i][j], *(f"{prefix}l{i}_{k} * {prefix}l{j}_{k}" for k in range(j))])
            below[f"{prefix}l{i}_{j}"] = f"({dot}) / {prefix}l{j}_{j}"
        dot = " - ".join([right[j], *(f"{prefix}l{j}_{k} * {prefix}y{k}" for k in range(j))])
        below[f"{prefix}y{j}"] = f"({dot}) / {prefix}l{j}_{j}"
        stages.append(below)
    return stages, " + ".join(f"power({prefix}y{k}, 2)" for k in range(n))


def granger(pairs: str, s: Series, lags: int = 5, cause: str = "rb", effect: str = "ra") -> str:
    """F statistic of whether `lags` past values of the cause explain the effect beyond its own past, of each pair.

    One grouped pass gives the moments of the lagged columns; the normal equations are solved by columns.
    """
    keys = ", ".join(s.keys)
    columns = [f"y{k}" for k in range(1, lags + 1)] + [f"x{k}" for k in range(1, lags + 1)]
    rows = staged(pairs, {"y0": effect} | {f"y{k}": s.lag(effect, k) for k in range(1, lags + 1)} | {f"x{k}": s.lag(cause, k) for k in range(1, lags + 1)})
    rows = f"(select * from {rows} r where y{lags} is not null and x{lags} is not null)"
    moment = {f"m_{a}_{b}": f"covar_pop({a}, {b})" for i, a in enumerate(columns) for b in columns[: i + 1]} | {f"m_{a}_y0": f"covar_pop({a}, y0)" for a in columns} | {"m_y0_y0": "var_pop(y0)"}
    grouped = f"(select {keys}, cast(count(*) as double) as n, {', '.join(f'{e} as {k}' for k, e in moment.items())} from {rows} g group by {keys} having count(*) > {2 * lags + 1})"
    name = lambda a, b: f"m_{a}_{b}" if columns.index(a) >= columns.index(b) else f"m_{b}_{a}"
    stages, whole = cholesky([[name(a, b) for b in columns] for a in columns], [f"m_{a}_y0" for a in columns], "u")
    own = " + ".join(f"power(uy{k}, 2)" for k in range(lags))  # the effect's own past comes first
    return staged(
        grouped,
        *stages,
        {"rss_own": f"n * (m_y0_y0 - ({own}))", "rss_all": f"n * (m_y0_y0 - ({whole}))"},
        {"f": f"((rss_own - rss_all) / {lags}) / nullif(rss_all / (n - {2 * lags + 1}), 0)"},
    )
