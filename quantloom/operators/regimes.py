"""Regimes, change points and durations over bars or labelled rows."""

from __future__ import annotations

from ..frames import Series, staged


def trend_regime(s: Series, source: str) -> str:
    """Five trend levels by three means' order and a month's momentum, and the trend's strength."""
    return staged(
        source,
        {"s20": s.roll("avg", "close", 20), "s50": s.roll("avg", "close", 50), "s200": s.roll("avg", "close", 200), "momentum": f"close / {s.lag('close', 20)} - 1"},
        {"score": "case when s200 is null then null else sign(close - s20) + sign(s20 - s50) + sign(s50 - s200) end"},
        {"trend": "case when score is null then -1 when score >= 3 and momentum > 0.02 then 4 when score >= 1 then 3 when score <= -3 and momentum < -0.02 then 0 when score <= -1 then 1 else 2 end", "strength": "abs(close / s50 - 1)"},
    )


def vol_regime(s: Series, source: str, vix: str = "vix") -> str:
    """Levels at 15, 28 and 35, changes, rank in a year, and a size multiplier."""
    return staged(
        source,
        {"vol_level": f"case when {vix} < 15 then 0 when {vix} < 28 then 1 when {vix} < 35 then 2 else 3 end", "change_1": f"{vix} - {s.lag(vix)}", "change_5": f"{vix} - {s.lag(vix, 5)}", "vix_rank": s.pct_rank(vix, 252)},
        {"multiplier": "case vol_level when 0 then 1.0 when 1 then 0.8 when 2 then 0.5 else 0.25 end"},
    )


def combined_regime(s: Series, source: str) -> str:
    """Four states of trend and volatility, -1 while warming up, with flags."""
    return staged(
        source,
        {"combined": "case when trend < 0 then -1 when trend >= 3 and vol_level <= 1 then 0 when trend >= 3 then 1 when vol_level <= 1 then 2 else 3 end"},
        {f"is_state_{k}": f"case when combined = {k} then 1 else 0 end" for k in range(4)},
    )


def label_history(s: Series, source: str, n: int = 50) -> str:
    """Ordered rules over drawdown, volatility and trend."""
    return staged(
        source,
        {"lr": f"ln(close / {s.lag('close')})", "peak": s.roll("max", "close", n), "mean": s.roll("avg", "close", n)},
        {"iv": f"{s.roll('stddev_samp', 'lr', 20)} * sqrt(252.0)", "drawdown": "close / peak - 1"},
        {"label": "case when mean is null or iv is null then null when drawdown < -0.01 and iv > 0.20 then 'crisis' when close > mean and iv <= 0.20 then 'bull' when close > mean then 'volatile_bull' when iv > 0.20 then 'bear' else 'sideways' end"},
    )


def moment_regime(s: Series, source: str) -> str:
    """Fragile, speculative or stable by rolling skewness and kurtosis (columns skew, kurtosis)."""
    return staged(source, {"moment_state": "case when skew is null then null when skew < -0.5 and kurtosis > 1 then 'fragile' when skew > 0.5 then 'speculative' else 'stable' end"})


def term_structure(s: Series, source: str) -> str:
    """Front and back volatility: backwardation, contango, zones at 12, 25 and 35."""
    return staged(
        source,
        {"spread": "back - front", "slope": "back / nullif(front, 0) - 1"},
        {"state": "case when slope < -0.02 then 'backwardation' when slope > 0.02 then 'contango' else 'flat' end", "zone": "case when front < 12 then 'low' when front < 25 then 'normal' when front < 35 then 'high' else 'extreme' end", "slope_change": f"slope - {s.lag('slope')}"},
    )


def _restarted(s: Series, step: str, drift: float = 0.0) -> tuple[dict[str, str], ...]:
    """Stages of two-sided sums of a step that restart at zero, by running extremes; the first row counts as zero."""
    return (
        {"up_": f"sum(case when row_ > 1 then {step} - {drift} else 0 end) {s.U}", "down_": f"sum(case when row_ > 1 then {step} + {drift} else 0 end) {s.U}"},
        {"cusum_up": f"up_ - least(0, min(up_) {s.U})", "cusum_down": f"down_ - greatest(0, max(down_) {s.U})"},
    )


def _alarms(s: Series, statistic: str, threshold: float) -> tuple[dict[str, str], ...]:
    """Stages of a flag where a statistic is above its threshold, and where it first is."""
    return (
        {"over_": f"case when {statistic} > {threshold} then 1 else 0 end"},
        {"alarm": f"case when over_ = 1 and coalesce({s.lag('over_')}, 0) = 0 then 1 else 0 end"},
    )


def reference(s: Series, source: str, x: str = "r", least: int = 20) -> str:
    """Number of each row, and mean and variance of the first fifth of a series, of `least` rows at least."""
    keys = ", ".join(s.keys)
    rows = staged(source, {"row_": f"row_number() {s.W}", "rows_": f"count({x}) over (partition by {keys})"}, {"frame_": f"greatest({least}, floor(rows_ / 5))"})
    inside = f"case when row_ <= frame_ then {x} end"
    return staged(rows, {"mu": f"avg({inside}) over (partition by {keys})", "variance": f"greatest(var_samp({inside}) over (partition by {keys}), 1e-20)"})


def cusum_mean(s: Series, source: str, x: str = "r", threshold: float = 5.0, drift: float = 0.0) -> str:
    """Two-sided cumulative sums of a standardised series, their larger side, and the rows where it first passes the threshold."""
    return staged(
        reference(s, source, x),
        {"z": f"({x} - mu) / greatest(sqrt(variance), 1e-10)"},
        *_restarted(s, "z", drift),
        {"statistic": "greatest(cusum_up, abs(cusum_down))"},
        *_alarms(s, "statistic", threshold),
    )


def cusum_variance(s: Series, source: str, x: str = "r", threshold: float = 5.0, ratio: float = 2.0) -> str:
    """Cumulative log-likelihood of `ratio` times the first rows' variance against it, restarted at zero, with alarms."""
    step = f"0.5 * {x} * {x} * (1 / greatest(variance, 1e-8) - 1 / greatest({ratio} * variance, 1e-8)) - 0.5 * ln(cast({ratio} as double))"
    return staged(reference(s, source, x), {"score": step}, *_restarted(s, "score"), {"statistic": "cusum_up"}, *_alarms(s, "statistic", threshold))


def regime_runs(s: Series, source: str, label: str = "label") -> str:
    """Runs of equal labels: key, run number, label, first and last time, length; the last run of a key is open."""
    keys = ", ".join(s.keys)
    rows = staged(source, {"turn": f"case when {label} is distinct from {s.lag(label)} then 1 else 0 end"}, {"run": f"sum(turn) {s.U}"})
    o = s.order[0]
    runs = f"(select {keys}, run, min({label}) as label, min({o}) as first_ts, max({o}) as last_ts, count(*) as length from {rows} r group by {keys}, run)"
    return f"(select *, case when run = max(run) over (partition by {keys}) then 1 else 0 end as is_open from {runs} q)"


def hazard_table(s: Series, runs: str) -> str:
    """Of closed runs, by label and length: hazard, survival, cumulative hazard and mean residual life."""
    counts = f"(select label, length, count(*) as ended from {runs} q where is_open = 0 and label is not null group by label, length)"
    by = "partition by label order by length"
    rest = f"{by} rows between current row and unbounded following"
    return staged(
        counts,
        {"at_risk": f"sum(ended) over ({rest})", "left_time": f"sum(ended * length) over ({rest})"},
        {"hazard": "cast(ended as double) / at_risk", "residual": "cast(left_time as double) / at_risk - length"},
        {"survival": f"exp(sum(case when hazard < 1 then ln(1 - hazard) else -700 end) over ({by}))", "cumulative_hazard": f"sum(hazard) over ({by})", "rising": f"case when hazard > lag(hazard) over ({by}) then 1 else 0 end"},
    )


def fit_durations(runs: str) -> str:
    """Moment fits of run lengths by label: geometric, Poisson, negative binomial, log-normal."""
    base = f"(select label, count(*) as runs, avg(cast(length as double)) as mean, var_samp(cast(length as double)) as variance, avg(ln(length)) as log_mean, stddev_samp(ln(length)) as log_dev from {runs} q where is_open = 0 and label is not null group by label)"
    return staged(base, {"geometric_p": "1 / mean", "poisson_rate": "mean", "nb_p": "case when variance > mean then mean / variance end", "nb_r": "case when variance > mean then mean * mean / (variance - mean) end"})


def transition_matrix(s: Series, source: str, label: str = "label") -> str:
    """Shares of the next label by label, over all keys."""
    steps = f"(select {label} as from_label, {s.lead(label)} as to_label from {source} r)"
    counts = f"(select from_label, to_label, count(*) as n from {steps} q where from_label is not null and to_label is not null group by from_label, to_label)"
    return f"(select *, cast(n as double) / sum(n) over (partition by from_label) as share from {counts} c)"


def bar_state(s: Series, source: str) -> str:
    """Four bits: price up, volume above its mean, close in the upper half, range above what log volume explains."""
    return staged(
        source,
        {"rng": "high - low", "lv": "ln(greatest(volume, 1))", "up": f"case when close > {s.lag('close')} then 1 else 0 end", "v20": s.roll("avg", "volume", 20)},
        {"slope": f"covar_pop(rng, lv) {s.P(100)} / nullif(var_pop(lv) {s.P(100)}, 0)", "mr": f"avg(rng) {s.P(100)}", "mv": f"avg(lv) {s.P(100)}"},
        {"expected": "mr + slope * (lv - mv)"},
        {"state": "case when v20 is null or expected is null then null else 8 * up + 4 * case when volume > v20 then 1 else 0 end + 2 * case when close - low > high - close then 1 else 0 end + case when rng > expected then 1 else 0 end end"},
    )


def sequences(s: Series, source: str, length: int = 3) -> str:
    """Rows with the sequence of their last states, and whether the next close is higher."""
    seq = ", ".join([*(f"cast({s.lag('state', k)} as varchar(10))" for k in range(length - 1, 0, -1)), "cast(state as varchar(10))"])
    whole = " and ".join(["state is not null", *(f"{s.lag('state', k)} is not null" for k in range(1, length))])
    nxt = s.lead("close")
    return staged(source, {"sequence": f"case when {whole} then concat_ws('-', {seq}) end", "rose": f"case when {nxt} > close then cast(1 as double) when {nxt} is not null then cast(0 as double) end"})


def pattern_table(s: Series, source: str, length: int = 3, least: int = 10) -> str:
    """Share of rises after each sequence of states in each regime: sequence, regime, n, share and edge over the base rate."""
    rows = sequences(s, source, length)
    table = f"(select sequence, regime, count(*) as n, avg(rose) as p_up from {rows} p where sequence is not null and regime is not null and rose is not null group by sequence, regime having count(*) >= {least})"
    return f"(select t.*, t.p_up - b.base as edge from {table} t cross join (select avg(rose) as base from {rows} q where rose is not null) b)"


def duration_hazards(d, fits: str, longest: int = 30) -> str:
    """Hazards over a grid of durations by label: geometric, Weibull and log-logistic by moments, and negative binomial.

    fits: label, mean, variance, log_dev.  A Weibull's shape comes from the ratio of deviation to mean, a log-logistic's
    from the deviation of logarithms; the negative binomial's hazard is its mass over what is left of it.
    """
    shape = staged(
        fits,
        {"ratio": "greatest(sqrt(variance) / mean, 0.05)", "excess": "greatest(mean - 1, 0.01)"},
        {"weibull_k": "power(ratio, -1.086)", "logistic_b": "greatest(1.05, 3.141592653589793 / sqrt(3.0) / greatest(log_dev, 0.05))", "fit_p": "excess / greatest(variance, excess * 1.01)"},
        {"weibull_scale": "mean / (1 - 0.427 / weibull_k + 0.411 / (weibull_k * weibull_k))", "fit_r": "excess * fit_p / (1 - fit_p)"},
    )
    grid = f"(select *, {d.explode(d.series('1', str(longest)), 't')} from {shape} f)"
    mass = staged(grid, {"log_ratio": "case when t > 1 then ln((t - 2 + fit_r) / nullif(t - 1, 0) * (1 - fit_p)) else fit_r * ln(fit_p) end"}, {"pmf": "exp(sum(log_ratio) over (partition by label order by t))"}, {"left_": "greatest(1 - (sum(pmf) over (partition by label order by t) - pmf), 1e-15)"})
    return staged(
        mass,
        {
            "geometric": "1 / mean",
            "weibull": "weibull_k / weibull_scale * power(t / weibull_scale, weibull_k - 1)",
            "log_logistic": "logistic_b / exp(log_mean) * power(t / exp(log_mean), logistic_b - 1) / (1 + power(t / exp(log_mean), logistic_b))",
            "negative_binomial": "least(1, pmf / left_)",
        },
    )


def tag(s: Series, source: str) -> str:
    """Regime by volatility level, its term structure, skew and momentum, with a confidence; missing inputs are estimated.

    source: close, vix; vix9d and skew may be null.
    """
    rows = staged(
        source,
        {"r_": f"close / {s.lag('close')} - 1", "momentum": f"coalesce(close / {s.lag('close', 20)} - 1, 0)"},
        {"realized": f"{s.roll('stddev_samp', 'r_', 20)} * sqrt(252.0)"},
        {"v": "coalesce(vix, realized * 120, 18)"},
        {"short_v": "coalesce(vix9d, v * 0.95)", "wing": "coalesce(skew, 0)"},
        {"slope": "case when short_v > 0 then (v - short_v) / short_v else 0 end"},
    )
    order = (
        ("v > 30 and slope < -0.05", "CRASH_ACCELERATION", "least(1, (v - 30) / 10)"),
        ("v < 15 and momentum > 0.05", "MELT_UP", "least(1, momentum / 0.10)"),
        ("v < 15 and momentum > 0.02", "LOW_VOL_GRIND", "1 - v / 15"),
        ("v between 15 and 25", "HIGH_VOL_OSCILLATION", "1 - abs(v - 22.5) / 7.5"),
        ("v > 25 and wing > 5", "CRASH_ACCELERATION", "0.7"),
        ("v > 25", "HIGH_VOL_OSCILLATION", "0.8"),
    )
    pick = lambda k, rest: "case " + " ".join(f"when {o[0]} then {k(o)}" for o in order) + f" else {rest} end"
    return staged(rows, {"regime": pick(lambda o: f"'{o[1]}'", "'LOW_VOL_GRIND'"), "confidence": pick(lambda o: f"cast({o[2]} as double)", "cast(0.5 as double)")})


def sector_regime(s: Series, source: str, lag: int = 1) -> str:
    """Momentum score, relative strength, trend quality, flow, composite and five states of each sector, with multipliers.

    source: close, volume, bench (the benchmark's close on the day).
    """
    rows = staged(source, {"price": s.lag("close", lag), "vol": s.lag("volume", lag), "base": s.lag("bench", lag)})
    momentum = {f"momentum_{w}": f"greatest(0, least(100, (((price - {s.lag('price', w)}) / ({s.lag('price', w)} + 1e-10)) * 100 + 20) / 40 * 100))" for w in (20, 60, 120)}
    strength = {f"rs_{w}": f"(price / {s.lag('price', w)}) / greatest(base / {s.lag('base', w)}, 0.01)" for w in (20, 60, 120)}
    rows = staged(
        rows,
        momentum | strength | {"high_10": s.roll("max", "price", 10), "low_10": s.roll("min", "price", 10), "r": f"price / {s.lag('price')} - 1"},
        {"momentum_score": "0.5 * momentum_20 + 0.3 * momentum_60 + 0.2 * momentum_120", "hh_": f"case when high_10 > {s.lag('high_10', 10)} then 1 else 0 end", "hl_": f"case when low_10 > {s.lag('low_10', 10)} then 1 else 0 end", "flow": f"100 * {s.roll('sum', 'r * vol', 20)} / greatest({s.roll('sum', 'vol', 20)}, vol * 0.01)"},
        {"hh": s.roll("sum", "hh_", 60), "hl": s.roll("sum", "hl_", 60)},
        {"trend_quality": "greatest(0, least(100, hh / 5.0 * 50 + hl / 5.0 * 30 + (hh + hl) / 10.0 * 20))", "flow_state": "case when flow is null then -1 when flow > 0.5 then 4 when flow > 0.2 then 3 when flow >= -0.2 then 2 when flow >= -0.5 then 1 else 0 end"},
        {"composite": "0.5 * momentum_score + 0.3 * greatest(0, least(100, (rs_60 - 0.8) / 0.4 * 100)) + 0.2 * trend_quality"},
        {"state": "case when composite is null then 'none' when composite >= 80 and rs_60 >= 1.15 then 'parabolic' when composite >= 65 and rs_60 >= 1.05 then 'bull' when composite >= 65 then 'none' when composite >= 40 then 'neutral' when composite >= 25 then 'bear' else 'crash' end", "confidence": "greatest(0, least(100, 0.7 * trend_quality + case when momentum_score > 50 then 30 else 0 end))"},
    )
    of = lambda *v: "case state " + " ".join(f"when '{k}' then {x}" for k, x in zip(("parabolic", "bull", "neutral", "bear", "crash"), v, strict=True))
    return staged(rows, {"sigma_shift": f"{of(0.5, 0.3, 0.0, -0.2, -0.5)} else 0.0 end", "size_multiplier": f"{of(1.5, 1.2, 1.0, 0.7, 0.3)} else 1.0 end"})


def opportunities(s: Series, source: str, least: float = 0.5) -> str:
    """Turns of regime, extremes of volatility and of strength, each with a confidence of `least` or more.

    source: close, iv.
    """
    rows = staged(
        source,
        {"r_": f"close / {s.lag('close')} - 1", "change": f"close - {s.lag('close')}", "sma_10": s.roll("avg", "close", 10), "sma_50": s.roll("avg", "close", 50), "iv_low": f"min(iv) {s.U}", "iv_high": f"max(iv) {s.U}"},
        {"short_vol": s.roll("stddev_samp", "r_", 10), "long_vol": s.roll("stddev_samp", "r_", 50), "gain": s.roll("avg", "greatest(change, 0)", 14), "loss": s.roll("avg", "greatest(-change, 0)", 14), "iv_rank": "case when iv_high > iv_low then (iv - iv_low) / (iv_high - iv_low) else 0.5 end"},
        {"rsi": "case when loss = 0 then 100 else 100 - 100 / (1 + gain / nullif(loss, 0)) end", "vol_change": "coalesce(abs(short_vol - long_vol) / nullif(long_vol, 0), 0)"},
    )
    keys = ", ".join([*s.keys, *s.order])
    kinds = (
        ("regime_transition", "long_vol is not null and (vol_change > 0.3 or (close > sma_10 and sma_10 > sma_50) or (close < sma_10 and sma_10 < sma_50))", "least(0.9, 0.5 + vol_change)"),
        ("high_volatility", "iv > 0.30", "least(0.85, 0.5 + iv_rank * 0.4)"),
        ("low_volatility", "iv < 0.15", "least(0.75, 0.4 + (1 - iv_rank) * 0.4)"),
        ("overbought", "rsi > 70", "least(0.7, 0.4 + (rsi - 70) / 60)"),
        ("oversold", "rsi < 30", "least(0.7, 0.4 + (30 - rsi) / 60)"),
    )
    found = " union all ".join(f"select {keys}, '{k}' as kind, cast({c} as double) as confidence from {rows} o{i} where {w}" for i, (k, w, c) in enumerate(kinds))
    return f"(select * from ({found}) f where confidence >= {least})"
