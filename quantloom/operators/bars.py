"""Features of price bars: symbol, ts, open, high, low, close, volume.

Each function takes a Series and a source relation and returns a relation with more columns.  Floors and clips are part
of the definitions.
"""

from __future__ import annotations

from ..frames import Series, staged

TRUE_RANGE = "greatest(high - low, abs(high - prev_close), abs(low - prev_close))"


def returns(s: Series, source: str, lookbacks=(1, 2, 5, 10, 20, 60, 120), logs=(1, 5, 20)) -> str:
    """Relative and log returns over several lookbacks."""
    simple = {f"return_{k}": f"close / greatest({s.lag('close', k)}, 1e-10) - 1" for k in lookbacks}
    return staged(source, simple | {f"log_return_{k}": f"ln(greatest(close, 1e-10) / greatest({s.lag('close', k)}, 1e-10))" for k in logs})


def ohlc_shape(s: Series, source: str) -> str:
    """Body, wicks, range and where open and close lie in it."""
    return staged(
        source,
        {"bar_range": "high - low", "body": "close - open", "upper_wick": "high - greatest(open, close)", "lower_wick": "least(open, close) - low"},
        {"body_ratio": "abs(body) / greatest(bar_range, 1e-10)", "upper_ratio": "upper_wick / greatest(bar_range, 1e-10)", "lower_ratio": "lower_wick / greatest(bar_range, 1e-10)", "close_position": "(close - low) / greatest(bar_range, 1e-10)", "open_position": "(open - low) / greatest(bar_range, 1e-10)", "range_share": "bar_range / greatest(close, 1e-10)", "bullish": "case when close > open then 1 else 0 end"},
    )


def gaps(s: Series, source: str) -> str:
    """The gap from the previous close, and whether the bar filled it."""
    return staged(
        source,
        {"prev_close": s.lag("close")},
        {"gap": "open - prev_close", "gap_share": "(open - prev_close) / greatest(prev_close, 1e-10)"},
        {"gap_filled": "case when gap > 0 and low <= prev_close then 1 when gap < 0 and high >= prev_close then 1 else 0 end", "gap_up": "case when gap > 0 then 1 else 0 end", "gap_down": "case when gap < 0 then 1 else 0 end"},
    )


def volume_features(s: Series, source: str) -> str:
    """Volume against its past, signed volume, and relative volume."""
    means = {f"relative_volume_{n}": f"volume / greatest({s.roll('avg', 'volume', n)}, 1e-10)" for n in (10, 20, 50)}
    change = {"volume_change": f"volume / greatest({s.lag('volume')}, 1e-10) - 1"} | {f"volume_vs_{n}": f"volume / greatest({s.roll('avg', 'volume', n)}, 1e-10) - 1" for n in (5, 20)}
    return staged(source, change | means | {"signed_volume": f"volume * sign(close - {s.lag('close')})"})


def derivatives(s: Series, source: str) -> str:
    """Velocity, acceleration and jerk of returns, normalised by range, and long momentum."""
    return staged(
        source,
        {"velocity": f"close / {s.lag('close')} - 1", "prev_close": s.lag("close"), "momentum_long": f"close / greatest({s.lag('close', 240)}, 1e-10) - 1"},
        {"acceleration": f"velocity - {s.lag('velocity')}", "true_range": TRUE_RANGE},
        {"jerk": f"acceleration - {s.lag('acceleration')}", "atr_14": s.roll("avg", "true_range", 14)},
        {"velocity_atr": "(close - prev_close) / greatest(atr_14, 1e-10)", "power": "velocity * volume"},
    )


def rolling_stats(s: Series, source: str, windows=(5, 20)) -> str:
    """Mean, deviation, extremes, z-scores and rank over several windows."""
    out = {}
    for n in windows:
        out |= {f"mean_{n}": s.roll("avg", "close", n), f"std_{n}": s.roll("stddev_samp", "close", n), f"min_{n}": s.roll("min", "close", n), f"max_{n}": s.roll("max", "close", n), f"price_z_{n}": s.z("close", n, 0.001), f"volume_z_{n}": s.z("volume", n, 0.001), f"rank_{n}": s.pct_rank("close", n)}
    return staged(source, out, {f"range_{n}": f"max_{n} - min_{n}" for n in windows})


def moments(s: Series, source: str, n: int = 20, x: str = "r") -> str:
    """Skewness and excess kurtosis of a frame, from its raw power sums (population moments)."""
    p = {f"m{k}": s.roll("avg", f"power({x}, {k})" if k > 1 else x, n) for k in (1, 2, 3, 4)}
    return staged(
        source,
        p,
        {"c2": "m2 - m1 * m1", "c3": "m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1", "c4": "m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1"},
        {"skew": "c3 / nullif(power(c2, 1.5), 0)", "kurtosis": "c4 / nullif(c2 * c2, 0) - 3"},
    )


def gain_loss(s: Series, source: str, n: int = 14) -> str:
    """Average gains and losses, their ratio, and distance from the window's extremes."""
    return staged(
        source,
        {"change": f"close - {s.lag('close')}"},
        {"avg_gain": s.roll("avg", "case when change > 0 then change when change is not null then 0 end", n), "avg_loss": s.roll("avg", "case when change < 0 then -change when change is not null then 0 end", n), "up_bars": s.roll("sum", "case when change > 0 then 1 when change is not null then 0 end", n), "down_bars": s.roll("sum", "case when change < 0 then 1 when change is not null then 0 end", n), "from_high": f"close / {s.roll('max', 'high', n)} - 1", "from_low": f"close / {s.roll('min', 'low', n)} - 1"},
        {"gain_loss_ratio": "avg_gain / greatest(avg_loss, 1e-10)", "consistency": f"abs(up_bars - down_bars) / {n}.0"},
    )


def micro(s: Series, source: str, n: int = 20) -> str:
    """Efficiency, buying and selling pressure, and volume concentration."""
    return staged(
        source,
        {"prev_close": s.lag("close"), "step": f"abs(close - {s.lag('close')})"},
        {"efficiency": f"abs(close - {s.lag('close', n)}) / greatest({s.roll('sum', 'step', n)}, 1e-10)", "buy_pressure": "(close - low) / greatest(high - low, 1e-10)", "sell_pressure": "(high - close) / greatest(high - low, 1e-10)", "concentration": f"{s.roll('max', 'volume', n)} / greatest({s.roll('sum', 'volume', n)}, 1e-10)", "true_range": TRUE_RANGE},
    )


def forward_targets(s: Series, source: str, horizons=(1, 5, 15, 60)) -> str:
    """Forward returns, and the next bar's direction; null where the future is missing."""
    return staged(source, {f"forward_{k}": f"{s.lead('close', k)} / close - 1" for k in horizons} | {"direction": f"cast(sign({s.lead('close')} - close) as int)"})


def triple_barrier(s: Series, source: str, horizon: int = 15, profit: float = 1.0, loss: float = 1.0, atr: int = 20) -> str:
    """+1, -1 or 0 by the first of two range-scaled barriers touched within the horizon; profit is tested first."""
    d = s.d
    pair = "struct(high as h, low as l)" if d.spark else "{'h': high, 'l': low}"
    if not d.spark:
        pair = "struct_pack(h := high, l := low)"
    up, down = f"close + {profit} * atr", f"close - {loss} * atr"
    # the position of the first touch of each barrier among the next rows
    ahead = "ahead"
    first = lambda cond: d.filter(d.series("1", d.size(ahead)), "i", cond)
    at = lambda f: f"{ahead}[i - 1].{f}" if d.spark else f"{ahead}[i].{f}"
    return staged(
        source,
        {"prev_close": s.lag("close")},
        {"true_range": TRUE_RANGE},
        {"atr": s.roll("avg", "true_range", atr), "ahead": f"{d.collect(pair)} {s.F(horizon)}"},
        {"n_ahead": f"coalesce({d.size(ahead)}, 0)"},
        {"hit_up": f"case when n_ahead > 0 and atr is not null then {d.item(first(f'{at("h")} >= {up}'), 1)} end", "hit_down": f"case when n_ahead > 0 and atr is not null then {d.item(first(f'{at("l")} <= {down}'), 1)} end"},
        {"barrier": f"case when atr is null or n_ahead < {horizon} then null when hit_up is not null and (hit_down is null or hit_up <= hit_down) then 1 when hit_down is not null then -1 else 0 end"},
    )


def realized_vol(s: Series, source: str, windows=(5, 10, 20)) -> str:
    """Annualised deviation of log returns."""
    return staged(source, {"lr": f"ln(close / {s.lag('close')})"}, {f"rv_{n}": f"{s.roll('stddev_samp', 'lr', n)} * sqrt(252.0)" for n in windows})


def atr(s: Series, source: str, windows=(5, 14)) -> str:
    """Mean true range."""
    return staged(source, {"prev_close": s.lag("close")}, {"true_range": TRUE_RANGE}, {f"atr_{n}": s.roll("avg", "true_range", n) for n in windows})


def trend_metrics(s: Series, source: str) -> str:
    """Moving averages, their slopes, price against them, returns and the range."""
    return staged(
        source,
        {"ma_20": s.roll("avg", "close", 20), "ma_50": s.roll("avg", "close", 50), "return_5": f"close / {s.lag('close', 5)} - 1", "return_10": f"close / {s.lag('close', 10)} - 1", "return_20": f"close / {s.lag('close', 20)} - 1", "range_10": f"({s.roll('max', 'high', 10)} - {s.roll('min', 'low', 10)}) / close"},
        {"slope_20": f"ma_20 / {s.lag('ma_20', 5)} - 1", "slope_50": f"ma_50 / {s.lag('ma_50', 5)} - 1", "vs_ma_20": "close / ma_20 - 1", "vs_ma_50": "close / ma_50 - 1"},
    )


def ema(d, x: str, span: int, over: str) -> str:
    """Adjusted exponential mean over the rows of `over`: weights fall by (1 - 2 / (span + 1)) a row."""
    keep = 1 - 2 / (span + 1)
    a = f"{d.collect(x)} {over}"
    weights = f"list_transform({a}, lambda v, i: v * pow({keep!r}, len({a}) - i))"
    return f"list_sum({weights}) / list_sum(list_transform({a}, lambda v, i: pow({keep!r}, len({a}) - i)))"


def sma(s: Series, source: str) -> str:
    """Simple means of ten and fifty rows."""
    return staged(source, {"sma_10": s.roll("avg", "close", 10), "sma_50": s.roll("avg", "close", 50)})


def sma_ema(s: Series, source: str) -> str:
    """Simple and exponential means, and where they cross.  source: close, ema_12, ema_26, signal_9."""
    return staged(
        sma(s, source),
        {"vs_sma_10": "close / sma_10 - 1", "macd": "ema_12 - ema_26", "prev_10": s.lag("sma_10"), "prev_50": s.lag("sma_50")},
        {"cross_up": "case when sma_10 > sma_50 and prev_10 <= prev_50 then 1 else 0 end", "cross_down": "case when sma_10 < sma_50 and prev_10 >= prev_50 then 1 else 0 end", "macd_histogram": "macd - signal_9"},
    )


def rsi(s: Series, source: str, periods=(7, 14)) -> str:
    """Rate of change, and relative strength by simple means; without losses it is 100."""
    out = {"change": f"close - {s.lag('close')}"} | {f"roc_{n}": f"close / {s.lag('close', n)} - 1" for n in periods}
    gain = {f"gain_{n}": s.roll("avg", "case when change > 0 then change when change is not null then 0 end", n) for n in periods}
    loss = {f"loss_{n}": s.roll("avg", "case when change < 0 then -change when change is not null then 0 end", n) for n in periods}
    return staged(source, out, gain | loss, {f"rsi_{n}": f"case when loss_{n} = 0 then 100 else 100 - 100 / (1 + gain_{n} / nullif(loss_{n}, 0)) end" for n in periods})


def bollinger_keltner(s: Series, source: str, n: int = 20) -> str:
    """Bands by deviation and by range around a mean.  source: close, high, low, ema_20."""
    return staged(
        source,
        {"mid": s.roll("avg", "close", n), "dev": s.roll("stddev_samp", "close", n), "prev_close": s.lag("close")},
        {"upper": "mid + 2 * dev", "lower": "mid - 2 * dev", "true_range": TRUE_RANGE},
        {"percent_b": "(close - lower) / nullif(upper - lower, 0)", "band_width": "(upper - lower) / mid", "atr_20": s.roll("avg", "true_range", 20)},
        {"keltner_upper": "ema_20 + 2 * atr_20", "keltner_lower": "ema_20 - 2 * atr_20"},
    )


def range_position(s: Series, source: str, n: int = 20) -> str:
    """Where the close lies between the window's extremes; the middle if they are one."""
    return staged(source, {"highest": s.roll("max", "high", n), "lowest": s.roll("min", "low", n)}, {"position": "case when highest is null then null when highest = lowest then 0.5 else (close - lowest) / (highest - lowest) end"})


def cumulative_volume(s: Series, source: str) -> str:
    """On-balance volume, cumulative volume-weighted price, accumulation line."""
    return staged(
        source,
        {"signed": f"coalesce(sign(close - {s.lag('close')}), 0) * volume", "typical": "(high + low + close) / 3", "flow": "case when high = low then 0 else ((close - low) - (high - close)) / (high - low) * volume end"},
        {"obv": f"sum(signed) {s.U}", "vwap_cumulative": f"sum(typical * volume) {s.U} / sum(volume) {s.U}", "ad_line": f"sum(flow) {s.U}"},
    )


def volume_trend(s: Series, source: str) -> str:
    """Volume against its means, and a flag for high volume."""
    return staged(source, {"v_10": s.roll("avg", "volume", 10), "v_20": s.roll("avg", "volume", 20), "v_50": s.roll("avg", "volume", 50)}, {"volume_ratio": "volume / v_20", "volume_trend": "v_10 / v_50", "high_volume": "case when volume > 1.5 * v_20 then 1 else 0 end"})


def vol_state(s: Series, source: str, n: int = 100) -> str:
    """Rank of volatility in its past, its tercile at that point in time, and whether ranges expand."""
    return staged(
        source,
        {"prev_close": s.lag("close"), "lr": f"ln(close / {s.lag('close')})"},
        {"true_range": TRUE_RANGE, "vol": s.roll("stddev_samp", "lr", 20)},
        {"atr_10": s.roll("avg", "true_range", 10), "atr_50": s.roll("avg", "true_range", 50), "vol_rank": s.pct_rank("vol", n)},
        {"expanding": "case when atr_10 > atr_50 then 1 else 0 end", "vol_tercile": "case when vol_rank is null then null when vol_rank <= 1.0 / 3 then 'low' when vol_rank <= 2.0 / 3 then 'medium' else 'high' end"},
    )


def pivots(s: Series, source: str) -> str:
    """Pivot levels from the previous bar."""
    return staged(
        source,
        {"ph": s.lag("high"), "pl": s.lag("low"), "pcl": s.lag("close")},
        {"pivot_level": "(ph + pl + pcl) / 3"},
        {"r1": "2 * pivot_level - pl", "s1": "2 * pivot_level - ph", "r2": "pivot_level + ph - pl", "s2": "pivot_level - (ph - pl)", "from_pivot": "close / pivot_level - 1"},
    )


def structure(s: Series, source: str) -> str:
    """Higher highs and lower lows, trend scores, support, resistance and breakouts."""
    return staged(
        source,
        {"hh": f"case when high > {s.lag('high')} then 1 else 0 end", "hl": f"case when low > {s.lag('low')} then 1 else 0 end", "lh": f"case when high < {s.lag('high')} then 1 else 0 end", "ll": f"case when low < {s.lag('low')} then 1 else 0 end", "resistance": s.roll("max", "high", 20), "support": s.roll("min", "low", 20)},
        {"up_score": s.roll("sum", "hh + hl", 5), "down_score": s.roll("sum", "lh + ll", 5), "breakout_up": f"case when close > {s.lag('resistance')} then 1 else 0 end", "breakout_down": f"case when close < {s.lag('support')} then 1 else 0 end"},
    )


def momentum_scores(s: Series, source: str, windows=(12, 60, 240), lag: int = 1) -> str:
    """Tiered points of lagged returns over several windows, their mean, the trend state, and how long it has lasted.

    Points don't count direction; a signed score and the change of each return stand beside them.  A missing return has
    no points.  States: 0 below 50, 1 below 80, 2 from there; the points end at 30, so the upper two are not reached.
    """
    tiers = lambda v: f"case when abs({v}) > 0.05 then 30.0 when abs({v}) > 0.02 then 15.0 when abs({v}) > 0.005 then 5.0 else 0.0 end"
    v = {f"v_{n}": f"{s.lag('close', lag)} / {s.lag('close', n + lag)} - 1" for n in windows}
    points = {f"score_{n}": f"cast({tiers(f'v_{n}')} as double)" for n in windows} | {f"accel_{n}": f"v_{n} - {s.lag(f'v_{n}', n)}" for n in windows} | {"log_volume": f"ln({s.lag('volume', lag)} + 1)"}
    mean = " + ".join(f"score_{n}" for n in windows)
    signed = {f"signed_{n}": f"score_{n} * sign(v_{n})" for n in windows}
    return staged(
        source,
        v,
        points,
        signed | {"composite": f"({mean}) / {len(windows)}", "mean_volume": s.roll("avg", "log_volume", 60)},
        {"state": "case when composite >= 80 then 2 when composite >= 50 then 1 else 0 end", "power": "composite * log_volume / greatest(greatest(mean_volume, log_volume * 0.01), 0.01)"},
        {"turn": f"case when state is distinct from {s.lag('state')} then 1 else 0 end"},
        {"island": f"sum(turn) {s.U}"},
        {"run_length": f"row_number() over (partition by {', '.join(s.keys)}, island order by {', '.join(s.order)})"},
    )


def mtf_momentum(s: Series, source: str) -> str:
    """Returns over three spans, how many agree, and divergence of the short from the long."""
    return staged(
        source,
        {"short": f"close / {s.lag('close', 5)} - 1", "medium": f"close / {s.lag('close', 20)} - 1", "long": f"close / {s.lag('close', 60)} - 1"},
        {"alignment": "sign(short) + sign(medium) + sign(long)"},
        {"full_bull": "case when alignment = 3 then 1 else 0 end", "full_bear": "case when alignment = -3 then 1 else 0 end", "divergence": "case when sign(short) * sign(long) < 0 then 1 else 0 end"},
    )


def rolling_vol(s: Series, source: str, n: int = 20) -> str:
    """Annualised deviation of the last n log returns."""
    return staged(source, {"lr": f"ln(close / {s.lag('close')})"}, {"vol": f"{s.roll('stddev_samp', 'lr', n)} * sqrt(252.0)"})


def vol_dynamics(s: Series, source: str) -> str:
    """Realised volatility, its change, and whether it expands against its own deviation."""
    return staged(
        source,
        {"lr": f"ln(close / {s.lag('close')})"},
        {"vol": f"{s.roll('stddev_samp', 'lr', 20)} * sqrt(252.0)"},
        {"vol_velocity": f"(vol - {s.lag('vol', 5)}) / 5"},
        {"vol_spread": s.roll("stddev_samp", "vol_velocity", 60)},
        {"vol_trend": "case when vol_spread is null then null when vol_velocity > vol_spread then 'expanding' when vol_velocity < -vol_spread then 'contracting' else 'stable' end"},
    )


def ou_fit(s: Series, source: str, n: int = 252, x: str = "close") -> str:
    """Mean reversion from regressing the value on its lag: speed, level and half-life within limits."""
    return staged(
        source,
        {"x1": s.lag(x)},
        {"cnt": f"count(x1) {s.R(n)}", "beta": f"covar_pop({x}, x1) {s.R(n)} / nullif(var_pop(case when {x} is not null then x1 end) {s.R(n)}, 0)", "my": f"avg(case when x1 is not null then {x} end) {s.R(n)}", "mx": f"avg(x1) {s.R(n)}"},
        {"kappa": f"case when cnt >= {n - 1} and beta > 0 and beta < 1 then -ln(beta) end"},
        {"theta": "case when kappa is not null then (my - beta * mx) / (1 - beta) end", "half_life": "case when ln(2.0) / kappa between 1 and 252 then ln(2.0) / kappa end"},
    )


def autocorr_warning(s: Series, source: str, n: int = 60, x: str = "r") -> str:
    """Lag-one autocorrelation and variance of the rows before, their z-scores, and a flag when both rise."""
    return staged(
        source,
        {"x1": s.lag(x)},
        {"ac1": f"case when count(x1) {s.P(n - 1)} >= {n - 1} then corr({x}, x1) {s.P(n - 1)} end", "var60": s.roll("var_pop", x, n, past=True)},
        {"ac_z": s.z("ac1", 252), "var_z": s.z("var60", 252)},
        {"warning": "case when ac_z > 1 and var_z > 1 then 1 else 0 end"},
    )


def momentum_backtest(s: Series, source: str, lookback: int = 20, threshold: float = 0.0) -> str:
    """Hold while yesterday's momentum exceeds the threshold; equity by compounding."""
    return staged(
        source,
        {"r": f"close / {s.lag('close')} - 1", "momentum": f"close / {s.lag('close', lookback)} - 1"},
        {"position": f"case when {s.lag('momentum')} > {threshold} then 1 else 0 end"},
        {"strategy_return": "position * coalesce(r, 0)", "trade": f"case when position <> coalesce({s.lag('position')}, 0) then 1 else 0 end"},
        {"equity": f"exp(sum(ln(1 + strategy_return)) {s.U})"},
        {"peak": f"max(equity) {s.U}"},
        {"drawdown": "equity / peak - 1"},
    )
