"""Queries of entropy, divergence, causality and the structure of correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..frames import DUCK, SPARK, Dialect, Series, output, spark_sql, staged
from ..operators import bars as B
from ..operators import information as I
from ..operators import recursions as R
from ..operators import spectra, tails
from . import views
from .more_queries import pairs
from .registry import bound, native, query, relation

DAY, PAIR = ("symbol", "ts"), ("a", "b", "ts")


def returned(d: Dialect) -> str:
    """Returns of every symbol, rounded so that bins have the same edges in both engines."""
    return f"(select symbol, ts, close, volume, round(r, 9) as r from {views.returns(d)} x where r is not null)"


def _series(name: str, op, rounded, plain=(), digits=6, **params) -> None:
    query(name, lambda d: output(op(Series(d), returned(d), **params), DAY, rounded, plain, digits))


_series("i01_rolling_entropy", I.rolling_entropy, ["entropy"])
_series("i07_rolling_divergence", I.rolling_divergence, ["kl", "kl_both"], digits=5)
_series("i11_entropy_dynamics", I.entropy_dynamics, ["entropy", "velocity", "acceleration"], ["decaying"])
_series("i25_entropy_decay", I.entropy_decay, ["entropy", "decay"])
_series("i26_entropy_equilibrium", I.entropy_equilibrium, ["level", "distance", "decay_rate", "half_life"], digits=4)
_series("b36_derivatives", I.derivative_estimates, ["velocity", "acceleration", "jerk", "snap", "reversal"], ["inflection"], digits=6, x="close")


def shaped(d: Dialect, window: int = 60) -> str:
    """Rolling skewness and excess kurtosis of returns."""
    return f"(select symbol, ts, round(skew, 7) as skew, round(kurtosis, 7) as kurtosis from {B.moments(Series(d), returned(d), window)} m)"


query("i12_shape_velocity", lambda d: output(I.shape_velocity(Series(d), shaped(d)), DAY, ["skew_velocity", "kurtosis_velocity", "transition"], ["direction"]))
query("i08_js_divergence", lambda d: output(I.pair_divergence(d, f"(select distinct a, b from {pairs(d)} z)", returned(d)), ("a", "b"), ["js"]))
query("i23_granger", lambda d: output(tails.f_tail(d, I.granger(f"(select a, b, ts, ra, rb from {pairs(d)} p union all select b as a, a as b, ts, rb as ra, ra as rb from {pairs(d)} q)", Series(d, ("a", "b"))), "p", "f", "5", "n - 11"), ("a", "b"), ["f", "p"], ["n"], 4))


def profile(d: Dialect, bins: int = 10) -> str:
    """Skewness, kurtosis, class and number of modes of each symbol's returns; a mode is a peak of the histogram."""
    base = f"(select symbol, min(r) as low, max(r) - min(r) as width, avg(r) as m1, avg(r * r) as m2, avg(r * r * r) as m3, avg(r * r * r * r) as m4 from {returned(d)} x group by symbol)"
    shape = staged(
        base,
        {"c2": "m2 - m1 * m1", "c3": "m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1", "c4": "m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1"},
        {"skew": "c3 / power(c2, 1.5)", "kurtosis": "c4 / (c2 * c2) - 3"},
        {"shape": "case when skew > 0.5 then 'P' when skew < -0.5 then 'b' when kurtosis > 1 then 'fat_tail' else 'normal' end"},
    )
    counts = f"(select x.symbol, {I.bin_of('x.r', 's.low', 's.width', bins)} as bin, count(*) as n from {returned(d)} x join {base} s on x.symbol = s.symbol where s.width > 0 group by x.symbol, {I.bin_of('x.r', 's.low', 's.width', bins)})"
    around = staged(counts, {"left_n": "case when lag(bin) over (partition by symbol order by bin) = bin - 1 then lag(n) over (partition by symbol order by bin) else 0 end", "right_n": "case when lead(bin) over (partition by symbol order by bin) = bin + 1 then lead(n) over (partition by symbol order by bin) else 0 end"})
    modes = f"(select symbol, count(*) as modes from {around} c where n > left_n and n >= right_n group by symbol)"
    return f"(select s.symbol, s.skew, s.kurtosis, s.shape, coalesce(m.modes, 1) as modes from {shape} s left join {modes} m on s.symbol = m.symbol)"


query(
    "i10_shape_profiles",
    lambda d: f"select a.symbol as a, b.symbol as b, round(0.3 * exp(-abs(a.skew - b.skew)) + 0.2 * exp(-abs(a.kurtosis - b.kurtosis) / 2) + 0.2 * exp(-abs(a.modes - b.modes)) + case when a.shape = b.shape then 0.3 else 0 end, 6) as similarity from {profile(d)} a join {profile(d)} b on a.symbol < b.symbol",
)


def effective_transfer(d: Dialect, surrogates: int = 20) -> str:
    """Transfer entropy less its mean over shuffles of the source, for all ordered pairs in one job.

    A shuffle orders a pair's rows by a mixed number of row and seed; values change places by that order.
    """
    by = lambda *c: f"over (partition by {', '.join(c)})"
    bins = f"(select symbol, ts, ntile(3) over (partition by symbol order by r, ts) as k, lead(ts) over (partition by symbol order by ts) as nxt from {returned(d)} x)"
    steps = f"(select a.symbol, a.ts, a.k, b.k as k1 from {bins} a join {bins} b on a.symbol = b.symbol and a.nxt = b.ts)"
    rows = f"(select x.symbol as target, y.symbol as source, x.k1, x.k as x0, y.k as y0, row_number() over (partition by x.symbol, y.symbol order by x.ts) as i from {steps} x join {bins} y on x.ts = y.ts and x.symbol <> y.symbol)"
    seeds = f"(select *, {d.explode(d.series('1', str(surrogates)), 'seed')} from {rows} r)"
    mixed = f"(select *, row_number() over (partition by target, source, seed order by (cast(i as bigint) * 1103515245 + cast(seed as bigint) * 1299709 + cast(i as bigint) * i % 65537 * seed * 7919) % 2147483647, i) as place from {seeds} s)"
    shuffled = f"(select m.target, m.source, m.seed, m.k1, m.x0, o.y0 from {mixed} m join {rows} o on m.target = o.target and m.source = o.source and m.place = o.i)"
    every = f"(select target, source, 0 as seed, k1, x0, y0 from {rows} r union all select target, source, seed, k1, x0, y0 from {shuffled} s)"
    counts = f"(select target, source, seed, k1, x0, y0, cast(count(*) as double) as c from {every} e group by target, source, seed, k1, x0, y0)"
    key = ("target", "source", "seed")
    p = staged(counts, {"n": f"sum(c) {by(*key)}", "c_xy": f"sum(c) {by(*key, 'x0', 'y0')}", "c_1x": f"sum(c) {by(*key, 'k1', 'x0')}", "c_x": f"sum(c) {by(*key, 'x0')}"})
    te = f"(select source, target, seed, sum(c / n * log2(c * c_x / (c_xy * c_1x))) as te from {p} q group by source, target, seed)"
    return f"(select source, target, sum(case when seed = 0 then te end) as raw, avg(case when seed > 0 then te end) as noise from {te} t group by source, target)"


query("i05_effective_transfer", lambda d: f"select source, target, round(raw, 6) as raw, round(noise, 6) as noise, round(raw - noise, 6) as effective from {effective_transfer(d)} t")


# ---- conditional variance and correlation
def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns with the conditional variance h and the standardised residual eta."""
    rows = relation(spark, sf_dir, f"(select symbol, ts, r, var_pop(r) over (partition by symbol) as v from {returned(SPARK)} x)")
    return R.scan(rows, ("symbol",), ("ts",), R.Variance, "h double, eta double")


def garch_sql(d: Dialect, alpha: float = 0.05, beta: float = 0.9) -> str:
    """The recursion unrolled: weights fall geometrically over the rows before."""
    rows = f"(select symbol, ts, r, v, greatest(v * {1 - alpha - beta!r}, 1e-10) as omega, row_number() over (partition by symbol order by ts) as i, list(r * r) over (partition by symbol order by ts rows between 400 preceding and 1 preceding) as past from (select symbol, ts, r, var_pop(r) over (partition by symbol) as v from {returned(d)} x) y)"
    h = f"omega * (1 - pow({beta}, i - 1)) / (1 - {beta}) + pow({beta}, i - 1) * v + {alpha} * coalesce(list_sum(list_transform(past, lambda p, k: p * pow({beta}, len(past) - k))), 0)"
    return f"(select symbol, ts, r, h, r / sqrt(h) as eta from (select *, greatest({h}, 1e-10) as h from {rows} z) g)"


native("i21_garch", lambda spark, sf_dir: bound(spark, output("{rows}", DAY, ["h", "eta"], [], 9), rows=varied(spark, sf_dir)), output(garch_sql(DUCK), DAY, ["h", "eta"], [], 9))


def joint(eta: str, rho: str) -> str:
    """Residuals of two symbols on common days, with their correlation over all of them."""
    rows = f"(select a.symbol as a, b.symbol as b, a.ts, a.eta as x, b.eta as y from {eta} a join {eta} b on a.ts = b.ts and a.symbol < b.symbol)"
    return f"(select *, corr(x, y) over (partition by a, b) as {rho} from {rows} p)"


def dcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, f"select * from {joint('{eta}', 'rho')} j", eta=varied(spark, sf_dir))
    return bound(spark, output("{rows}", PAIR, ["dcc"], [], 6), rows=R.scan(rows, ("a", "b"), ("ts",), R.Correlation, "dcc double"))


def dcc_sql(d: Dialect, a: float = 0.01, b: float = 0.95) -> str:
    frame = "over (partition by a, b order by ts rows between 900 preceding and 1 preceding)"
    rows = f"(select *, row_number() over (partition by a, b order by ts) as i, list(x * x) {frame} as xx, list(y * y) {frame} as yy, list(x * y) {frame} as xy from {joint(garch_sql(d), 'rho')} j)"
    path = lambda past, start: f"({start} * ({1 - a - b!r} * (1 - pow({b}, i - 1)) / (1 - {b}) + pow({b}, i - 1)) + {a} * coalesce(list_sum(list_transform({past}, lambda p, k: p * pow({b}, len({past}) - k))), 0))"
    return f"(select a, b, ts, {path('xy', 'rho')} / sqrt({path('xx', '1')} * {path('yy', '1')}) as dcc from {rows} r)"


native("i22_dcc", dcc, output(dcc_sql(DUCK), PAIR, ["dcc"], [], 6))


# ---- eigenvalues of rolling covariances
SPECTRUM = list(spectra.MEASURES)


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of the returns of all symbols over the sixty days before each day, over the days on which both of a pair traded."""
    return spectra.correlation_spectra(relation(spark, sf_dir, f"(select symbol, ts, r from {returned(SPARK)} x)"))


def correlation_features(spark: SparkSession, sf_dir: str, lag: int = 1) -> DataFrame:
    """The measures a row late, z-scores over a year, the correlation regime and a flag for fragility."""
    d = SPARK
    s = Series(d, ("one",))
    z = lambda c: f"case when count({c}) {s.R(252)} = 252 then ({c} - avg({c}) {s.R(252)}) / nullif(stddev_samp({c}) {s.R(252)}, 0) end"
    rows = staged("(select 1 as one, * from {rows})", {f"{c}_lagged": s.lag(c, lag) for c in SPECTRUM}, {"ratio_z": z("absorption_lagged"), "entropy_z": z("entropy_lagged")})
    regime = "case when ratio_z is null or entropy_z is null then 'INSUFFICIENT_DATA' when ratio_z > 2 and entropy_z < -2 then 'HIGH_CORRELATION_CRISIS' when ratio_z > 2 then 'ELEVATED_CORRELATION' when ratio_z < -2 then 'LOW_CORRELATION_DIVERSIFIED' else 'NORMAL' end"
    rows = staged(rows, {"corr_regime": regime, "fragile": "case when ratio_z > 2 and entropy_z < -2 then 1 else 0 end"})
    return bound(spark, output(rows, ("ts",), [f"{c}_lagged" for c in SPECTRUM] + ["ratio_z", "entropy_z"], ["corr_regime", "fragile"], 6), rows=spectrum(spark, sf_dir))


native("i16_absorption", lambda spark, sf_dir: bound(spark, output("{rows}", ("ts",), SPECTRUM, ["instruments"], 6), rows=spectrum(spark, sf_dir)))
native("i17_correlation_features", correlation_features)
native("i24_correlation_snapshot", lambda spark, sf_dir: correlation_features(spark, sf_dir).orderBy("ts", ascending=False).limit(1))


def entropy_snapshot(d: Dialect) -> str:
    """The latest entropy, its decay and divergence of each symbol, and a state."""
    rows = I.entropy_decay(Series(d), I.rolling_divergence(Series(d), returned(d)))
    last = lambda c: f"{d.last(c, 'ts')} as {c}"
    return f"(select symbol, max(ts) as ts, {last('entropy')}, {last('decay')}, {last('kl')} from {rows} r where entropy is not null and decay is not null and kl is not null group by symbol)"


query("i24_entropy_snapshot", lambda d: f"select symbol, ts, round(entropy, 6) as entropy, round(decay, 6) as decay, round(kl, 5) as kl, case when decay < -0.01 then 'ordering' when decay > 0.01 then 'disordering' else 'steady' end as state from {entropy_snapshot(d)} s")


def contagion(d: Dialect) -> str:
    """Correlations in stressed and calm times, the stressed one corrected for its variance, and whether it still stands out.

    Stress is a day on which the first symbol's deviation over the rows before is in its upper fifth.
    """
    s = Series(d, ("a", "b"))
    rows = staged(pairs(d), {"dev": s.roll("stddev_samp", "ra", 20, past=True)}, {"seen": "count(dev) over (partition by a, b)", "k": "rank() over (partition by a, b order by round(dev, 12) desc)"}, {"stress": "case when dev is null then null when k <= 0.2 * seen then 1 else 0 end"})
    side = lambda f, k, *c: f"{f}({', '.join(f'case when stress = {k} then {x} end' for x in c)})"
    base = f"(select a, b, {side('corr', 1, 'ra', 'rb')} as rho_stress, {side('corr', 0, 'ra', 'rb')} as rho_calm, {side('var_pop', 1, 'ra')} as v1, {side('var_pop', 0, 'ra')} as v0 from {rows} r group by a, b)"
    return staged(
        base,
        {"var_ratio": "case when v0 > 1e-10 then greatest(0.01, least(100, v1 / v0)) else 1 end"},
        {"rho_adjusted": "rho_stress / nullif(sqrt(1 + (var_ratio - 1) * (1 - rho_stress * rho_stress)), 0)"},
        {"is_contagion": "case when rho_adjusted > rho_calm + 0.1 then 1 else 0 end"},
    )


query("i20_contagion_test", lambda d: output(contagion(d), ("a", "b"), ["rho_stress", "rho_calm", "rho_adjusted", "var_ratio"], ["is_contagion"], 5))
