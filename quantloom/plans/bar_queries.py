"""Queries of the bar features over daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..frames import DUCK, SPARK, Series, output, staged
from ..operators import bars as B
from ..operators import recursions as R
from . import views
from .registry import bound, native, query, relation

KEYS = ("symbol", "ts")


def _bars(name: str, op, rounded, plain=(), digits=6, source=views.bars, **params) -> None:
    query(name, lambda d: output(op(Series(d), source(d), **params), KEYS, rounded, plain, digits))


_bars("b01_returns", B.returns, [f"return_{k}" for k in (1, 2, 5, 10, 20, 60, 120)] + [f"log_return_{k}" for k in (1, 5, 20)])
_bars("b02_ohlc_shape", B.ohlc_shape, ["bar_range", "body", "upper_wick", "lower_wick", "body_ratio", "upper_ratio", "lower_ratio", "close_position", "open_position", "range_share"], ["bullish"])
_bars("b03_gaps", B.gaps, ["gap", "gap_share"], ["gap_filled", "gap_up", "gap_down"])
_bars("b04_volume_features", B.volume_features, ["volume_change", "volume_vs_5", "volume_vs_20", "relative_volume_10", "relative_volume_20", "relative_volume_50", "signed_volume"])
_bars("b05_derivatives", B.derivatives, ["velocity", "acceleration", "jerk", "velocity_atr", "power", "momentum_long"], digits=5)
_bars("b06_rolling_stats", B.rolling_stats, [f"{c}_{n}" for n in (5, 20) for c in ("mean", "std", "min", "max", "range", "price_z", "volume_z", "rank")], digits=5)
_bars("b06_moments", B.moments, ["skew", "kurtosis"], digits=4, source=views.returns)
_bars("b07_gain_loss", B.gain_loss, ["avg_gain", "avg_loss", "from_high", "from_low", "gain_loss_ratio", "consistency"], ["up_bars", "down_bars"], digits=5)
_bars("b08_micro", B.micro, ["efficiency", "buy_pressure", "sell_pressure", "concentration", "true_range"], digits=7)
_bars("b09_forward_targets", B.forward_targets, ["forward_1", "forward_5", "forward_15", "forward_60"], ["direction"])
_bars("b10_triple_barrier", B.triple_barrier, ["atr"], ["barrier"], digits=4)
_bars("b11_realized_vol", B.realized_vol, ["rv_5", "rv_10", "rv_20"], digits=5)
_bars("b12_atr", B.atr, ["atr_5", "atr_14"], digits=4)
_bars("b13_trend_metrics", B.trend_metrics, ["ma_20", "ma_50", "slope_20", "slope_50", "vs_ma_20", "vs_ma_50", "return_5", "return_10", "return_20", "range_10"], digits=5)
_bars("b14_derived_features", lambda s, src: B.trend_metrics(s, B.atr(s, B.realized_vol(s, src))), ["rv_20", "atr_14", "ma_20", "slope_20", "range_10"], digits=5)
_bars("b16_rsi", B.rsi, ["roc_7", "roc_14", "rsi_7", "rsi_14"], digits=4)
_bars("b19_range_position", B.range_position, ["highest", "lowest", "position"])
_bars("b20_cumulative_volume", B.cumulative_volume, ["obv", "vwap_cumulative", "ad_line"], digits=3)
_bars("b21_volume_trend", B.volume_trend, ["volume_ratio", "volume_trend"], ["high_volume"])
_bars("b22_vol_state", B.vol_state, ["vol_rank", "atr_10", "atr_50"], ["expanding", "vol_tercile"], digits=4)
_bars("b23_pivots", B.pivots, ["pivot_level", "r1", "s1", "r2", "s2", "from_pivot"], digits=5)
_bars("b24_structure", B.structure, ["resistance", "support"], ["hh", "hl", "lh", "ll", "up_score", "down_score", "breakout_up", "breakout_down"])
_bars("b26_momentum_scores", B.momentum_scores, ["v_12", "v_60", "v_240", "accel_12", "signed_12", "composite", "power"], ["state", "run_length"], digits=5)
_bars("b28_mtf_momentum", B.mtf_momentum, ["short", "medium", "long"], ["alignment", "full_bull", "full_bear", "divergence"])
_bars("b37_vol_dynamics", B.vol_dynamics, ["vol", "vol_velocity"], ["vol_trend"], digits=5)
_bars("b38_ou_fit", B.ou_fit, ["beta", "kappa", "half_life"], digits=4)
_bars("b39_autocorr_warning", B.autocorr_warning, ["ac1", "var60", "ac_z", "var_z"], ["warning"], digits=4, source=views.returns)
_bars("e20_momentum_backtest", B.momentum_backtest, ["momentum", "strategy_return", "equity", "drawdown"], ["position", "trade"], digits=5)
query("b30_rolling_pct_rank", lambda d: f"select symbol, ts, round(cast({Series(d).pct_rank('close', 60)} as double), 6) as pct_rank from {views.bars(d)} b")


# ---- exponential means: a recursion in Spark, held against weighted lists
MEANS = {"ema_12": (lambda c: c["close"], 12), "ema_20": (lambda c: c["close"], 20), "ema_26": (lambda c: c["close"], 26), "signal_9": (lambda c: c["ema_12"] - c["ema_26"], 9)}


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with their exponential means."""
    return R.scan(relation(spark, sf_dir, views.bars(SPARK)), ("symbol",), ("ts",), lambda: R.Means(MEANS), ", ".join(f"{m} double" for m in MEANS))


def smoothed_sql(d) -> str:
    over = lambda span: Series(d).R(20 * span)
    means = {f"ema_{n}": B.ema(d, "close", n, over(n)) for n in (12, 20, 26)}
    return staged(views.bars(d), means, {"macd_": "ema_12 - ema_26"}, {"signal_9": B.ema(d, "macd_", 9, over(9))})


def _smoothed(name: str, op, rounded, plain=()) -> None:
    def build(d, source: str) -> str:
        return output(op(Series(d), source), KEYS, rounded, plain, 7)

    native(name, lambda spark, sf_dir: bound(spark, build(SPARK, "{bars}"), bars=smoothed(spark, sf_dir)), build(DUCK, smoothed_sql(DUCK)))


_smoothed("b15_sma_ema", B.sma_ema, ["sma_10", "sma_50", "ema_12", "ema_26", "vs_sma_10"], ["cross_up", "cross_down"])
_smoothed("b17_macd", B.sma_ema, ["macd", "signal_9", "macd_histogram"])
_smoothed("b18_bollinger_keltner", B.bollinger_keltner, ["mid", "upper", "lower", "percent_b", "band_width", "keltner_upper", "keltner_lower"])
