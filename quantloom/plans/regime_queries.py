"""Queries of tagged, clustered and hidden regimes, change points, rotation and opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import SPARK, Dialect, Series, output, staged
from ..operators import recursions as R
from ..operators import clusters
from ..operators import regimes as G
from . import views
from .flow_queries import vixed
from .information_queries import returned
from .registry import bound, native, query, relation

DAY = ("symbol", "ts")


def with_skew(d: Dialect) -> str:
    """Bars with their volatility index, its short-dated form where the last week was lively, and a wing skew."""
    s = Series(d)
    return staged(vixed(d), {"short_vol": f"{s.roll('stddev_samp', 'vix_return', 9)} * 20"}, {"vix9d": "case when short_vol > vix then round(short_vol, 6) end", "skew": "case when close < open then round(100 * (open - close) / open, 6) end"})


query("g05_tag_regimes", lambda d: output(G.tag(Series(d), with_skew(d)), DAY, ["v", "slope", "momentum", "confidence"], ["regime"], 8))


def benched(d: Dialect) -> str:
    """Bars with the mean close of all symbols on the day."""
    return f"(select b.symbol, b.ts, b.close, b.volume, m.bench from {views.bars(d)} b join (select ts, avg(close) as bench from {views.bars(d)} c group by ts) m on b.ts = m.ts)"


query("g09_sector_regime", lambda d: output(G.sector_regime(Series(d), benched(d)), DAY, ["momentum_score", "rs_60", "trend_quality", "flow", "composite", "confidence", "sigma_shift", "size_multiplier"], ["flow_state", "state"], 4))


def rotation(d: Dialect, lookback: int = 20, threshold: float = 10.0) -> str:
    """Sectors that gain and lose momentum each day, the strength of the rotation, and between which categories it runs."""
    s = Series(d)
    rows = staged(G.sector_regime(s, benched(d)), {"change": f"momentum_score - {s.lag('momentum_score', lookback)}", "category": "case when symbol like 'ECONOMY%' or symbol like 'STANDARD%' then 'defensive' when symbol like 'PROMO%' or symbol like 'LARGE%' then 'growth' else 'cyclical' end"})
    mean = lambda c: f"avg(case when category = '{c}' then change end) as {c}"
    days = f"(select ts, sum(case when change > {threshold} then 1 else 0 end) as gaining, sum(case when change < -{threshold} then 1 else 0 end) as losing, {mean('defensive')}, {mean('growth')} from {rows} r group by ts)"
    return staged(days, {"rotating": "case when gaining > 0 and losing > 0 then 1 else 0 end", "strength": "least(10, gaining + losing) / cast(10 as double)", "kind": f"case when defensive < -{threshold} and growth > {threshold} then 'DEFENSIVE_TO_GROWTH' when growth < -{threshold} and defensive > {threshold} then 'GROWTH_TO_DEFENSIVE' else 'NONE' end"})


query("g10_rotation", lambda d: output(rotation(d), ("ts",), ["strength", "defensive", "growth"], ["gaining", "losing", "rotating", "kind"], 4))


def macro(d: Dialect) -> str:
    """Daily macro series of the orders: the share of open orders as a rate, a spread, a price level and its yearly change."""
    days = "(select o_orderdate as day, avg(case when o_orderstatus = 'O' then cast(1 as double) else 0 end) as open_share, avg(o_totalprice) as level, count(*) as n from {orders} group by o_orderdate)"
    over = "over (order by day rows between 19 preceding and current row)"
    return staged(days, {"unemployment": f"2 + 8 * avg(open_share) {over}", "curve": f"(avg(level) {over} - 150000) / 20000", "prices": f"avg(level) {over}"}, {"inflation": "100 * (prices / nullif(lag(prices, 252) over (order by day), 0) - 1)"})


def macro_features(d: Dialect, lag: int = 1) -> str:
    """Bars with the macro series of a row before, an inversion flag and the macro regime; missing days carry on."""
    s = Series(d)
    rows = f"(select b.symbol, b.ts, m.unemployment, m.curve, m.inflation from {views.bars(d)} b left join {macro(d)} m on cast(b.ts as date) = cast(m.day as date))"
    filled = {c: f"{d.last_seen(c + '_1')} {s.U}" for c in ("unemployment", "curve", "inflation")}
    return f"(select symbol, ts, u as unemployment, c as curve, i as inflation, case when c < 0 then 1 else 0 end as inverted, case when u > 6 then 'recession' when c < 0 then 'slowdown' else 'expansion' end as macro_regime from (select symbol, ts, {filled['unemployment']} as u, {filled['curve']} as c, {filled['inflation']} as i from {staged(rows, {c + '_1': s.lag(c, lag) for c in filled})} x) y)"


query("g11_macro_regime", lambda d: output(macro_features(d), DAY, ["unemployment", "curve", "inflation"], ["inverted", "macro_regime"], 5))


# ---- clusters
def regime_features(d: Dialect, n: int = 20) -> str:
    """Volatility, trend, relative volume, volatility of volatility and consistency of the trend."""
    s = Series(d)
    rows = staged(
        returned(d),
        {"volatility": f"{s.roll('stddev_samp', 'r', n)} * sqrt(252.0)", "trend": s.roll("sum", "r", n), "volume_ratio": f"volume / {s.roll('avg', 'volume', n)}", "rises": s.roll("sum", "case when r > 0 then 1 else 0 end", n), "falls": s.roll("sum", "case when r < 0 then 1 else 0 end", n)},
        {"vol_of_vol": s.roll("stddev_samp", "volatility", 20), "trend_consistency": f"case when trend > 0 then rises else falls end / cast({n} as double)"},
    )
    return f"(select symbol, ts, {', '.join(FEATURES)} from {rows} f where vol_of_vol is not null)"


FEATURES = ["volatility", "trend", "volume_ratio", "vol_of_vol", "trend_consistency"]


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.scaled(relation(spark, sf_dir, regime_features(SPARK)), FEATURES)


def named(rows: DataFrame, label: str) -> DataFrame:
    """A name for each cluster: its volatility against the quartiles, its trend, and whether that is consistent."""
    q = rows.agg(F.percentile_approx("volatility", F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias("q"))
    of = rows.groupBy(label).agg(F.avg("volatility").alias("v"), F.avg("trend").alias("t"), F.avg("trend_consistency").alias("c"), F.count("*").alias("n"))
    vol = F.when(F.col("v") > F.col("q")[1], "HighVol").when(F.col("v") < F.col("q")[0], "LowVol").otherwise("MidVol")
    trend = F.when(F.col("t") > 0.02, "Bull").when(F.col("t") < -0.02, "Bear").otherwise("Chop")
    return of.crossJoin(F.broadcast(q)).select(label, F.concat(vol, F.lit("_"), trend, F.when(F.col("c") > 0.6, "Trend").otherwise("")).alias("name"))


def cluster_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each row by k-means over scaled features, and its name."""
    rows = clusters.clustered(scaled(spark, sf_dir))
    return rows.join(F.broadcast(named(rows, "cluster")), "cluster").select("symbol", "ts", "cluster", "name")


def vote_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority of two k-means and a mixture, and the share that agrees."""
    return clusters.voted(scaled(spark, sf_dir)).select("symbol", "ts", "first", "second", "mixture", "regime", "confidence")


native("g12_cluster_regimes", cluster_regimes)
native("g13_vote_regimes", vote_regimes)


# ---- hidden states and change points
def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = R.pooled_states(relation(spark, sf_dir, returned(SPARK)), ("symbol",), ("ts",))
    return rows.select("symbol", "ts", *[F.round(c, 6).alias(c) for c in ("p0", "p1", "switch")], F.when(F.col("p1") > 0.5, 1).otherwise(0).alias("state"))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns with the posterior of the time since the last change."""
    rows = relation(spark, sf_dir, f"(select symbol, ts, r, r * 100 as x from {returned(SPARK)} v)")
    return R.scan(rows, ("symbol",), ("ts",), R.RunLengths, "change double, run_length double, mean double")


def segmented(rows: DataFrame) -> DataFrame:
    """Rows (symbol, ts, x) with the best division into segments of all rows up to each."""
    penalty = rows.groupBy("symbol").agg((2 * F.log(F.count("*"))).alias("penalty"))
    return R.scan(rows.join(F.broadcast(penalty), "symbol"), ("symbol",), ("ts",), R.Segments, "segment_start double, segments double")


def cusummed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, f"(select symbol, ts, statistic, alarm from {G.cusum_mean(Series(SPARK), returned(SPARK))} c)")


def change_point_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the chosen methods side by side: cumulative sums, run-length posterior and segments."""
    both = segmented(changed(spark, sf_dir).select("symbol", "ts", "x", "change", "run_length", "mean"))
    out = both.join(cusummed(spark, sf_dir), ["symbol", "ts"])
    return out.select("symbol", "ts", *[F.round(c, 6).alias(c) for c in ("statistic", "change", "mean")], "alarm", F.col("segments").cast("long").alias("segments"))


def transition_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the change's weight, 0.3 of the autocorrelation of the rows before and 0.2 of the cumulative sum, each in 0 to 1."""
    s = Series(SPARK)
    frame = s.P(19)
    rows = staged("{rows}", {"x1": s.lag("x")}, {"ac": f"case when count(x1) {frame} = 19 then coalesce(corr(x, x1) {frame}, 0) else 0 end"}, {"ac_signal": "greatest(0, least(1, (ac + 1) / 2))", "cusum_signal": "greatest(0, least(1, statistic / 10))"}, {"score": "0.5 * change + 0.3 * ac_signal + 0.2 * cusum_signal"})
    return bound(spark, output(rows, DAY, ["score", "change", "ac_signal", "cusum_signal"], [], 6), rows=changed(spark, sf_dir).join(cusummed(spark, sf_dir), ["symbol", "ts"]))


native("g14_hidden_states", hidden_states)
native("g17_run_length_posterior", lambda spark, sf_dir: bound(spark, output("{rows}", DAY, ["change", "run_length", "mean"], [], 6), rows=changed(spark, sf_dir)))
native("g18_segments", lambda spark, sf_dir: segmented(relation(spark, sf_dir, f"(select symbol, ts, r * 100 as x from {returned(SPARK)} v)")).select("symbol", "ts", F.col("segment_start").cast("long").alias("segment_start"), F.col("segments").cast("long").alias("segments")))
native("g19_change_point_features", change_point_features)
native("g20_transition_score", transition_score)


def with_iv(d: Dialect) -> str:
    return f"(select symbol, ts, close, round(vix / 100, 8) as iv from {vixed(d)} v)"


query("g31_opportunity_scan", lambda d: f"select symbol, ts, kind, round(confidence, 6) as confidence, row_number() over (partition by symbol order by round(confidence, 6) desc, ts, kind) as rank_ from {G.opportunities(Series(d), with_iv(d))} o")
