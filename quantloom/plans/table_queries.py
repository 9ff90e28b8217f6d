"""Queries of sources, cleaning, joins, resampling, evaluation, reports and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import SPARK, Series, output, staged
from ..operators import bars as B
from ..operators import evaluation as E
from ..sources.shared import new_path
from ..sources.store import KeyedTable
from . import views
from .flow_queries import labelled, vixed
from .registry import native, query, relation

D = "cast({} as double)"


def _r(x: str, n: int = 6) -> str:
    return f"round(cast({x} as double), {n}) + cast(0 as double)"


def _issues(d) -> str:
    """The issues of a bar as a list; null entries are none."""
    items = [("gap", f"{d.days('ts', 'prev_ts')} > 7"), ("jump", "abs(open / nullif(prev_close, 0) - 1) > 0.2"), ("price", "low <= 0"), ("range", "high < greatest(open, close) or low > least(open, close)")]
    parts = ", ".join(f"case when {c} then '{n}' end" for n, c in items)
    return f"array({parts})" if d.spark else f"[{parts}]"


def _two_sided(z: str) -> str:
    """Two-sided normal p-value of a statistic."""
    from ..operators.flow import normal_cdf

    return f"2 * (1 - {normal_cdf(f'abs({z})')})"


def _flags(d) -> str:
    items = (("sharpe", "sharpe > 3"), ("win_rate", "win_rate > 0.8"), ("drawdown", "max_dd > -0.01"), ("few", "n < 100"), ("none", "1 = 1"))
    parts = ", ".join(f"case when {c} then '{n}' else 'ok_{n}' end" for n, c in items)
    return f"array({parts})" if d.spark else f"[{parts}]"


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and kind, merged from a stream into a keyed table batch by batch; one batch comes twice."""
    ticks = relation(spark, sf_dir, views.events_ticks(SPARK)).select("user_id", "symbol", F.col("ts").cast("timestamp").alias("ts"), "event_id", "price", "size")
    feed = new_path(spark, "feed")
    ticks.repartitionByRange(4, F.col("event_id") % 97).write.parquet(feed)
    table = KeyedTable(spark, new_path(spark, "state"), ticks.schema, ("user_id", "symbol"), ("ts", "event_id"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    table.follow(stream, new_path(spark, "checkpoint"), "events").trigger(availableNow=True).start().awaitTermination()
    table.merge(ticks, table.version()["done"].get("events"), "events")
    return table.read().withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ---- sources and cleaning
query("s01_scan_bars", lambda d: f"select symbol, ts, open, high, low, close, volume from {views.bars(d)} b where symbol in ('ECONOMY', 'SMALL') and ts >= timestamp '1996-01-01' and ts < timestamp '1998-01-01'")
query("s05_ingest_quality", lambda d: f"select symbol, ts, count(*) as ticks, {d.counts('price <= 0')} as bad_price, {d.counts('size <= 0')} as zero_size, {d.counts('jump > 0.5')} as jumps, case when {d.counts('price <= 0')} > 0.01 * count(*) then 1 else 0 end as rejected from (select *, abs(price / lag(price) over (partition by symbol order by ts, l_orderkey, l_linenumber, l_extendedprice, l_quantity) - 1) as jump from {views.ticks(d)} t) x group by symbol, ts")
query("s08_coverage", lambda d: f"select symbol, min(ts) as first_ts, max(ts) as last_ts, count(distinct ts) as days, count(*) as ticks from {views.ticks(d)} t group by symbol")
query("s14_latest_per_key", lambda d: f"select symbol, ts, close, volume from (select *, row_number() over (partition by symbol order by ts desc) as k from {views.bars(d)} b) x where k = 1")
native(
    "s14_upsert_state",
    upserted,
    "select user_id, symbol, ts, event_id, price, size from (select user_id, event_type as symbol, ts, event_id, value as price, cast(json_extract_string(props, '$.k') as double) as size, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from {events}) x where k = 1",
)
query("s16_day_slice", lambda d: f"select symbol, ts, close, k from (select *, row_number() over (partition by symbol order by ts desc) as k from {views.bars(d)} b where ts <= timestamp '2000-06-30') x where k <= 100")
query("c01_parse_contract", lambda d: f"select code, {d.matches('code', 'O:([A-Z]+)[0-9]+[CP][0-9]+', 1)} as root, {d.matches('code', 'O:[A-Z]+[0-9]+([CP])[0-9]+', 1)} as opt, cast({d.matches('code', 'O:[A-Z]+[0-9]+[CP]([0-9]+)', 1)} as double) / 1000 as strike, cast(concat('20', substr({d.matches('code', 'O:[A-Z]+([0-9]+)[CP][0-9]+', 1)}, 1, 2)) as int) as year from (select concat('O:', upper(p_type), '240119', case when p_size % 2 = 0 then 'C' else 'P' end, lpad(cast(cast(p_retailprice * 1000 as bigint) as varchar(20)), 8, '0')) as code from {{part}}) x")
query("c05_synthetic_quotes", lambda d: f"select symbol, ts, l_orderkey, l_linenumber, price, {_r('price * 0.99')} as bid, {_r('price * 1.01')} as ask, {_r('greatest(price - 0.5 * greatest(0.01, 0.02 * price), 0.005)')} as modelled_bid from {views.ticks(d)} t")
query("c07_fill_and_cost", lambda d: f"select symbol, ts, l_orderkey, l_linenumber, {_r('filled')} as filled, {_r('price * (1 + case when filled > 30 then 0.001 when filled > 10 then 0.0005 else 0.0002 end)')} as fill_price, {_r('greatest(1, 0.005 * filled)')} as commission from (select *, least(size, 0.1 * sum(size) over (partition by symbol, ts)) as filled from {views.ticks(d)} t) x")
query("c10_trading_days_only", lambda d: f"select symbol, ts, close from {views.bars(d)} b where {d.weekday('ts')} < 5")
query("c11_validate_features", lambda d: " union all ".join(f"select '{c}' as feature, count(*) as n, count(*) - count({c}) as nulls, {_r(f'avg({c})', 4)} as mean, {_r(f'stddev_samp({c})', 4)} as dev, {_r(f'min({c})')} as least_value, {_r(f'max({c})')} as most_value from {B.returns(Series(d), views.bars(d))} b" for c in ("return_1", "return_20", "log_return_5")))
query("c12_check_quality", lambda d: f"select symbol, ts, issue from (select symbol, ts, {d.explode(_issues(d), 'issue')} from {staged(views.bars(d), {'prev_ts': Series(d).lag('ts'), 'prev_close': Series(d).lag('close')})} b) x where issue is not null")
query("c13_detect_gaps", lambda d: f"select symbol, prev_ts as gap_start, ts as gap_end, {d.days('ts', 'prev_ts')} as days from {staged(views.bars(d), {'prev_ts': Series(d).lag('ts')})} b where {d.days('ts', 'prev_ts')} > 2")
query("c14_session_flags", lambda d: f"select event_id, hour(ts) as hour_, minute(ts) as minute_, {d.weekday('ts')} as weekday_, month(ts) as month_, {d.isoweek('ts')} as week_, case when hour(ts) between 9 and 15 then 1 else 0 end as regular, case when month(ts) <> month({d.plus_days('cast(ts as date)', 1)}) then 1 else 0 end as month_end from {{events}}")
query("c15_calendar_features", lambda d: f"select event_id, hour(ts) * 60 + minute(ts) as minute_of_day, {_r('sin(2 * pi() * hour(ts) / 24)')} as hour_sin, {_r('cos(2 * pi() * hour(ts) / 24)')} as hour_cos, {_r('sin(2 * pi() * ' + d.weekday('ts') + ' / 7)')} as day_sin, case when hour(ts) = 12 then 1 else 0 end as lunch from {{events}}")
query("c18_rule_filter", lambda d: f"select symbol, ts, close from {B.rsi(Series(d), views.bars(d))} b where coalesce(rsi_14 < 40, false) and coalesce(roc_7 > -0.2, false) and coalesce(volume > 50, false)")


# ---- joins
query("j01_bars_with_vix", lambda d: f"select b.symbol, b.ts, b.close, m.mean_close from {views.bars(d)} b left join (select ts, {_r('avg(close)', 5)} as mean_close from {views.bars(d)} v group by ts) m on b.ts = m.ts")


def asof(d) -> str:
    """Each purchase with the user's last view at or before it: both sides in one ordered window."""
    both = f"(select user_id, ts, event_id, price, cast(null as double) as bid, cast(null as double) as ask, 1 as side from {views.buys(d)} t union all select user_id, ts, event_id, cast(null as double) as price, bid, ask, 0 as side from {views.quotes(d)} q)"
    w = "over (partition by user_id order by ts, side, event_id rows between unbounded preceding and current row)"
    return f"(select * from (select user_id, ts, event_id, price, side, {d.last_seen('bid')} {w} as bid, {d.last_seen('ask')} {w} as ask from {both} u) x where side = 1)"


query("j03_asof_backward", lambda d: f"select user_id, ts, event_id, price, {_r('bid')} as bid, {_r('ask')} as ask from {asof(d)} a")
query("o02_quote_sign", lambda d: f"select user_id, ts, event_id, case when price > mid then 1 when price < mid then -1 when mid is null then 0 else coalesce(sign(price - lag(price) over (partition by user_id order by ts, event_id)), 0) end as trade_sign from (select *, (bid + ask) / 2 as mid from {asof(d)} a) x")
query("j04_exposure_onto_bars", lambda d: f"select symbol, ts, close, lag(filled, 1) over (partition by symbol order by ts) as month_close from (select b.symbol, b.ts, b.close, {d.last_seen('m.last_close')} over (partition by b.symbol order by b.ts rows between unbounded preceding and current row) as filled from {views.bars(d)} b left join (select symbol, max(ts) as ts, {d.last('close', 'ts')} as last_close from {views.bars(d)} x group by symbol, date_trunc('month', ts)) m on b.symbol = m.symbol and b.ts = m.ts) y")
query("j08_macro_by_date", lambda d: f"select symbol, ts, lag(rate) over (partition by symbol order by ts) as rate from (select b.symbol, b.ts, m.rate from {views.bars(d)} b left join (select date_trunc('month', o_orderdate) as month_, {_r('avg(o_totalprice)', 3)} as rate from {{orders}} group by date_trunc('month', o_orderdate)) m on date_trunc('month', b.ts) = m.month_) x")
query("j09_pair_series", lambda d: f"select a.symbol as a, b.symbol as b, count(*) as n, {_r('corr(a.r, b.r)')} as correlation from {views.returns(d)} a join {views.returns(d)} b on a.ts = b.ts and a.symbol < b.symbol group by a.symbol, b.symbol")
query("j12_best_run", lambda d: f"select c_mktsegment, count(o_orderkey) as runs, max(o_totalprice) as best, {d.last('o_orderkey', 'o_totalprice', 'o_orderkey')} as best_run from {{customer}} left join {{orders}} on c_custkey = o_custkey group by c_mktsegment")
query("j13_next_day", lambda d: f"select symbol, ts, next_ts, {_r('next_close / close - 1')} as r from (select symbol, ts, close, lead(ts) over (partition by symbol order by ts) as next_ts, lead(close) over (partition by symbol order by ts) as next_close from {views.bars(d)} b) x where {d.days('next_ts', 'ts')} <= 5")
query("j14_missing_dates", lambda d: f"select distinct ts from {views.bars(d)} b where not exists (select 1 from {{orders}} o where o.o_orderdate = b.ts)")
query("j15_trades_with_regime", lambda d: f"select t.trade_id, t.strategy, l.label, {_r('t.pnl', 4)} as pnl from {views.trades(d)} t left join (select ts, label from {labelled(d)} x where symbol = 'ECONOMY') l on t.entry = l.ts")
query("j16_run_phase", lambda d: f"select t.trade_id, p.phase from {views.trades(d)} t left join (select 'early' as phase, timestamp '1995-01-01' as a, timestamp '1997-01-01' as b union all select 'middle', timestamp '1997-01-01', timestamp '1999-01-01' union all select 'late', timestamp '1999-01-01', timestamp '2003-01-01') p on t.entry >= p.a and t.entry < p.b")
query("j17_unaudited_top", lambda d: "select c_custkey, c_acctbal from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey) order by c_acctbal desc, c_custkey limit 50")

# ---- resampling and aggregation
for name, grain in (("a01_resample_week", "week"), ("a02_resample_month", "month"), ("a04_resample_quarter", "quarter")):
    query(name, lambda d, g=grain: f"select symbol, date_trunc('{g}', ts) as ts, {d.first('open', 'ts')} as open, max(high) as high, min(low) as low, {d.last('close', 'ts')} as close, sum(volume) as volume from {views.bars(d)} b group by symbol, date_trunc('{g}', ts)")
query("a05_last_value_daily", lambda d: f"select event_type, cast(ts as date) as day, {d.last('value', 'ts', 'event_id')} as last_value from {{events}} group by event_type, cast(ts as date)")
query("a06_pivot_wide", lambda d: "select ts, " + ", ".join(f"max(case when symbol = '{x}' then close end) as {x.lower()}" for x in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + f" from {views.bars(d)} b group by ts")
query("a16_metrics_by_regime", lambda d: f"select regime, days, {_r('total', 3)} as total, {_r('mean', 4)} as mean, {_r('sharpe')} as sharpe, {_r('win_rate')} as win_rate, {_r('drawdown', 3)} as max_drawdown from (select regime, count(*) as days, sum(pnl) as total, avg(pnl) as mean, avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252.0) as sharpe, avg(case when pnl > 0 then 1.0D else 0.0D end) as win_rate, min(equity - peak) as drawdown from (select *, max(equity) over (partition by regime order by entry, trade_id rows between unbounded preceding and current row) as peak from (select *, sum(pnl) over (partition by regime order by entry, trade_id rows between unbounded preceding and current row) as equity from {views.trades(d)} t) x) y group by regime) z".replace("1.0D", "cast(1 as double)").replace("0.0D", "cast(0 as double)"))
query("a18_regime_stability", lambda d: f"select symbol, year(ts) as year_, label, count(*) as n, {_r('cast(count(*) as double) / sum(count(*)) over (partition by symbol, year(ts))')} as share from {labelled(d)} l group by symbol, year(ts), label")
query("a20_regime_profile_matrix", lambda d: f"select regime, strategy, count(*) as runs, {_r('avg(pnl)', 4)} as mean_pnl from {views.trades(d)} t group by regime, strategy")
query("a21_stage_counts", lambda d: f"select event_type as stage, count(*) as n, {d.counts('value < 10')} as in_progress, {d.counts('value >= 10')} as completed from {{events}} group by event_type")
query("a22_funnel", lambda d: f"select reach, count(*) as users, {_r('100.0 * count(*) / max(total)')} as share from (select reached, total, {d.explode(d.series('1', 'cast(reached as int)'), 'reach')} from (select u.reached, t.total from (select user_id, count(distinct event_type) as reached from {{events}} group by user_id) u cross join (select count(distinct user_id) as total from {{events}}) t) x) y group by reach")
query("a23_failure_stats", lambda d: f"select l_returnflag as failure, count(*) as n, {_r('100.0 * count(*) / sum(count(*)) over ()')} as share, max(l_shipdate) as last_seen from {{lineitem}} group by l_returnflag")
query("a24_graduation_metrics", lambda d: f"select strategy, count(*) as n, {_r('sum(pnl)', 3)} as pnl, {_r('avg(case when pnl > 0 then cast(1 as double) else 0 end)')} as win_rate, {_r('sum(case when pnl > 0 then pnl else 0 end) / nullif(-sum(case when pnl < 0 then pnl else 0 end), 0)')} as profit_factor, {_r('case when count(*) < 3 then 0 when stddev_samp(pnl) = 0 then 0 else avg(pnl) / stddev_samp(pnl) * sqrt(252.0) end')} as sharpe from {views.trades(d)} t group by strategy")
query("a25_run_risk_summary", lambda d: f"select strategy, {_r('min(pnl)', 4)} as worst, {_r(d.quantile('pnl', 0.5), 4)} as median_pnl, {_r(d.quantile('pnl', 0.05), 4)} as tail, count(distinct year(entry)) as years from {views.trades(d)} t group by strategy")
query("a27_regime_strategy", lambda d: f"select regime, strategy, count(*) as n, {_r('case when count(*) < 10 then 0 else avg(pnl) / nullif(stddev_samp(pnl), 0) end')} as sharpe from {views.trades(d)} t group by regime, strategy")
query("a28_time_to_peak", lambda d: f"select profile, {_r(d.quantile('peak_day', 0.25))} as p25, {_r(d.quantile('peak_day', 0.5))} as p50, {_r(d.quantile('peak_day', 0.75))} as p75, {d.counts('peak_day <= 3')} as by_day_3 from (select trade_id, min(profile) as profile, {d.first('day', '-pnl', 'day')} as peak_day from {views.paths(d)} p group by trade_id) x group by profile")
query("a29_position_totals", lambda d: f"select l_suppkey as account, sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as net, {_r('case when sum(l_quantity) = 0 then 0 else sum(l_extendedprice) / sum(l_quantity) end', 4)} as avg_cost from {{lineitem}} group by l_suppkey")
query("a31_top_strategies", lambda d: "select o_orderkey, o_totalprice from {orders} where o_orderstatus = 'F' order by o_totalprice desc nulls last, o_orderkey limit 20")
query("a34_regime_patterns", lambda d: f"select strategy, {d.last('regime', 'm', 'regime')} as best, {d.first('regime', 'm', 'regime')} as worst from (select strategy, regime, round(avg(pnl), 4) as m from {views.trades(d)} t group by strategy, regime) x group by strategy")
query("a36_portfolio_summary", lambda d: f"select year(entry) as year_, count(*) as runs, {_r(d.quantile('pnl', 0.5), 4)} as median_pnl, {_r('stddev_samp(pnl)', 3)} as dev from {views.trades(d)} t group by year(entry)")
query("z01_grouping_sets", lambda d: f"select strategy, regime, count(*) as n, count(distinct account) as accounts from {views.trades(d)} t group by cube (strategy, regime)")

# ---- evaluation
ret = lambda d: f"(select symbol, ts, strategy_return as r from {B.momentum_backtest(Series(d), views.bars(d))} m)"
query("e02_expanding_z", lambda d: output(staged(views.returns(d), {"n": f"count(r) {Series(d).U}", "m": f"avg(r) {Series(d).U}", "s": f"stddev_samp(r) {Series(d).U}"}, {"z": "case when n >= 60 then (r - m) / greatest(s, 1e-10) end"}), ("symbol", "ts"), ["z"], digits=4))
query("e03_lookahead_check", lambda d: f"select symbol, {_r('early')} as early, {_r('late')} as late, case when least(early, late) / greatest(early, late) >= 0.5 then 1 else 0 end as stable from (select symbol, stddev_samp(case when half = 1 then r end) as early, stddev_samp(case when half = 2 then r end) as late from (select symbol, r, ntile(2) over (partition by symbol order by ts) as half from {views.returns(d)} x) y group by symbol) z")


def threshold_search(d) -> str:
    """Today's return as a factor of the next one's."""
    return E.threshold_search(d, f"(select symbol, round(r, 9) as x, lead(r) over (partition by symbol order by ts) as y from {views.returns(d)} x)")


query("e04_threshold_search", lambda d: output(threshold_search(d), ("symbol", "p"), ["threshold", "high_average", "low_average", "t", "t_df", "t_p", "exit_level"], ["high_n", "low_n", "best_above", "best_below"], 5))
query("e06_hysteresis_signals", lambda d: output(staged(B.rsi(Series(d), views.bars(d)), {"signal": f"coalesce({d.last_seen('case when rsi_14 < 40 then 1 when rsi_14 > 60 then 0 end')} {Series(d).U}, 0)"}), ("symbol", "ts"), ["rsi_14"], ["signal"], 4))
query("e09_three_set_split", lambda d: f"select symbol, ts, case when year(ts) = 2001 then 'holdout' when month(ts) % 2 = 1 then 'train' else 'test' end as part, case when row_number() over (partition by symbol, date_trunc('month', ts) order by ts) <= 2 then 1 else 0 end as embargo from {views.bars(d)} b")
query("e10_trades_from_signals", lambda d: f"select symbol, trade, min(ts) as entry_ts, max(ts) as exit_ts, count(*) as days_held, {_r('exp(sum(ln(1 + strategy_return))) - 1')} as pnl from (select *, sum(case when position = 1 and coalesce(was, 0) = 0 then 1 else 0 end) over (partition by symbol order by ts rows between unbounded preceding and current row) as trade_no from (select symbol, ts, position, strategy_return, lag(position) over (partition by symbol order by ts) as was from {B.momentum_backtest(Series(d), views.bars(d))} m) x) y where position = 1 group by symbol, trade_no".replace("symbol, trade, min", "symbol, trade_no, min"))


def performance(d, source: str, key: str = "symbol") -> str:
    """Return, deviation, Sharpe, Sortino, drawdown, Calmar, win rate, profit factor and t of returns by key."""
    o = f"over (partition by {key} order by ts rows between unbounded preceding and current row)"
    eq = staged(source, {"equity": f"exp(sum(ln(greatest(1 + coalesce(r, 0), 1e-9))) {o})"}, {"peak": f"max(equity) {o}"})
    base = f"(select {key}, count(r) as n, avg(r) as mean, stddev_samp(r) as dev, stddev_samp(least(r, 0)) as down, min(equity / peak - 1) as max_dd, avg(case when r > 0 then cast(1 as double) when r <= 0 then 0 end) as win_rate, sum(greatest(r, 0)) / nullif(-sum(least(r, 0)), 0) as profit_factor, sum(ln(greatest(1 + coalesce(r, 0), 1e-9))) as log_total from {eq} e group by {key})"
    return staged(base, {"sharpe": "mean / nullif(dev, 0) * sqrt(252.0)", "sortino": "mean * sqrt(252.0) / nullif(greatest(down, 1e-6), 0)", "annual": "exp(log_total / n * 252) - 1", "t_stat": "mean / nullif(dev / sqrt(n), 0)"}, {"calmar": "annual / nullif(-max_dd, 0)"})


PERF = ["mean", "dev", "sharpe", "sortino", "max_dd", "win_rate", "profit_factor", "log_total", "t_stat"]
query("e11_performance", lambda d: output(performance(d, ret(d)), ("symbol",), PERF, ["n"], 5))
query("e13_drawdown_table", lambda d: f"select symbol, spell, min(ts) as start_ts, max(ts) as end_ts, count(*) as days, {_r('min(drawdown)')} as depth from (select *, sum(case when drawdown >= 0 then 1 else 0 end) over (partition by symbol order by ts rows between unbounded preceding and current row) as spell from {B.momentum_backtest(Series(d), views.bars(d))} m) x where drawdown < 0 group by symbol, spell")
query("e14_three_set_validate", lambda d: f"select symbol, {_r('train')} as train, {_r('test')} as test, {_r('holdout')} as holdout, case when train > 0 and test > 0 and holdout > 0 then 1 else 0 end as survives from (select symbol, {', '.join(f'avg(case when {c} then r end) / nullif(stddev_samp(case when {c} then r end), 0) * sqrt(252.0) as {n}' for n, c in (('train', 'month(ts) % 2 = 1 and year(ts) < 2001'), ('test', 'month(ts) % 2 = 0 and year(ts) < 2001'), ('holdout', 'year(ts) = 2001')))} from {ret(d)} x group by symbol) y")
query("e16_allocate", lambda d: output(staged(performance(d, ret(d)), {"w": "greatest(sharpe, 0)", "iv": "1 / greatest(abs(max_dd), 0.01)"}, {"equal_weight": "cast(1 as double) / count(*) over ()", "sharpe_weight": "w / nullif(sum(w) over (), 0)", "risk_weight": "iv / sum(iv) over ()"}), ("symbol",), ["equal_weight", "sharpe_weight", "risk_weight"], [], 6))


def walk_forward_windows(d) -> str:
    """Train for 12 months and test for 3, in steps of 3, from the first bar; the last test ends by the last bar."""
    span = f"(select min(cast(ts as date)) as a, max(cast(ts as date)) as b from {views.bars(d)} x)"
    steps = f"(select a, b, {d.explode(d.series('0', 'cast((year(b) - year(a)) * 4 + 4 as int)'), 'k')} from {span} y)"
    ends = f"(select k, b, {d.plus_months('a', 'k * 3')} as train_start, {d.plus_months('a', 'k * 3 + 12')} as test_start, cast({d.plus_days(d.plus_months('a', 'k * 3 + 15'), -1)} as date) as test_end from {steps} z)"
    return f"select k, train_start, test_start, test_end from {ends} w where test_end <= b"


query("e22_walk_forward_windows", walk_forward_windows)
query("e24_sharpe_pvalue", lambda d: output(staged(performance(d, ret(d)), {"se": "sqrt((1 + mean / nullif(dev, 0) * mean / nullif(dev, 0) / 2) / n)"}, {"zscore": "mean / nullif(dev, 0) / se"}, {"p_value": _two_sided("zscore")}), ("symbol",), ["zscore", "p_value"], ["n"], 6))
query("e25_bh_correction", lambda d: output(staged(f"(select symbol, {_two_sided('t_stat')} as p from {performance(d, ret(d))} x)", {"rk": "row_number() over (order by p, symbol)", "m": "count(*) over ()"}, {"bonferroni": "least(1, p * m)", "raw": "p * m / rk"}, {"bh": "least(1, min(raw) over (order by rk rows between current row and unbounded following))"}), ("symbol",), ["p", "bonferroni", "bh"], ["rk"], 6))
query("e26_param_sweep", lambda d: f"select symbol, k, count(*) as n, {_r('avg(r * hold) / nullif(stddev_samp(r * hold), 0) * sqrt(252.0)', 5)} as sharpe from (select symbol, k, r, case when lag(close) over (partition by symbol, k order by ts) > lag(close, 1 + 5) over (partition by symbol, k order by ts) * (1 + k / cast(100 as double)) then 1 else 0 end as hold from (select symbol, ts, close, r, {d.explode(d.series('0', '4'), 'k')} from {views.returns(d)} x) y) z where r is not null group by symbol, k")
query("e28_overfit_flags", lambda d: f"select symbol, {d.explode(_flags(d), 'warning')} from {performance(d, ret(d))} x")
query("e34_exit_sweep", lambda d: f"select hold, count(*) as trades, {_r('sum(pnl)', 2)} as pnl, {_r('avg(case when pnl > 0 then cast(1 as double) else 0 end)')} as win_rate from (select trade_id, hold, {d.last('pnl', 'day')} as pnl from (select trade_id, day, pnl, {d.explode('array(1, 2, 3, 5)' if d.spark else '[1, 2, 3, 5]', 'hold')} from {views.paths(d)} p) x where day <= hold group by trade_id, hold) y group by hold")
query("e35_path_summary", lambda d: f"select trade_id, {_r('max(pnl)', 4)} as peak, {_r('min(pnl - top)', 4)} as drawdown, {d.first('day', '-pnl', 'day')} as peak_day, {_r(d.last('pnl', 'day'), 4)} as final_pnl, {d.counts('pnl > 0')} as positive_days from (select *, max(pnl) over (partition by trade_id order by day rows between unbounded preceding and current row) as top from {views.paths(d)} p) x group by trade_id")
query("e53_outcome_classes", lambda d: f"select outcome, count(*) as n, {_r('100.0 * count(*) / sum(count(*)) over ()')} as share from (select case when max(pnl) <= 20 then 'peakless' when {d.first('day', '-pnl', 'day')} <= 1 then 'early_fail' else 'good' end as outcome from {views.paths(d)} p group by trade_id) x group by outcome")
query("e44_var", lambda d: f"select symbol, {_r('-' + d.quantile('r', 0.05))} as var_95, {_r('-' + d.quantile('r', 0.01))} as var_99 from {views.returns(d)} x where r is not null group by symbol")
query("e51_time_folds", lambda d: f"select symbol, fold, count(*) as n, {_r('avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0)', 5)} as sharpe from (select symbol, r, ntile(5) over (partition by symbol order by ts) as fold from {ret(d)} x) y group by symbol, fold")


# ---- information and correlation
query("i14_corr_matrix", lambda d: output(staged(f"(select a.symbol as a, b.symbol as b, a.ts, a.r as ra, b.r as rb from {views.returns(d)} a join {views.returns(d)} b on a.ts = b.ts and a.symbol < b.symbol where a.r is not null and b.r is not null)", {"n": f"count(*) {Series(d, ('a', 'b')).P(60)}", "corr_60": f"corr(ra, rb) {Series(d, ('a', 'b')).P(60)}", "cov_60": f"covar_samp(ra, rb) {Series(d, ('a', 'b')).P(60)}"}, {"c": "case when n = 60 then corr_60 end", "v": "case when n = 60 then cov_60 end"}), ("a", "b", "ts"), ["c", "v"], ["n"], 5))
query("i15_corr_summary", lambda d: f"select ts, count(c) as pairs, {_r('avg(c)', 5)} as mean_corr, {_r('max(abs(c))', 5)} as max_abs from (select ts, case when count(*) {Series(d, ('a', 'b')).P(60)} = 60 then corr(ra, rb) {Series(d, ('a', 'b')).P(60)} end as c from (select a.symbol as a, b.symbol as b, a.ts, a.r as ra, b.r as rb from {views.returns(d)} a join {views.returns(d)} b on a.ts = b.ts and a.symbol < b.symbol where a.r is not null and b.r is not null) x) y group by ts")
query("i19_tail_dependence", lambda d: f"select a, b, {_r('lower_n / nullif(0.05 * n, 0)', 5)} as lower_tail, {_r('upper_n / nullif(0.05 * n, 0)', 5)} as upper_tail from (select a, b, count(*) as n, cast({d.counts('ka <= 0.05 and kb <= 0.05')} as double) as lower_n, cast({d.counts('ka >= 0.95 and kb >= 0.95')} as double) as upper_n from (select a, b, rank() over (partition by a, b order by ra) / cast(count(*) over (partition by a, b) + 1 as double) as ka, rank() over (partition by a, b order by rb) / cast(count(*) over (partition by a, b) + 1 as double) as kb from (select a.symbol as a, b.symbol as b, a.r as ra, b.r as rb from {views.returns(d)} a join {views.returns(d)} b on a.ts = b.ts and a.symbol < b.symbol where a.r is not null and b.r is not null) x) y group by a, b) z")
query("i20_contagion", lambda d: f"select a, b, {_r('corr(case when calm = 1 then ra end, case when calm = 1 then rb end)', 5)} as calm_corr, {_r('corr(case when calm = 0 then ra end, case when calm = 0 then rb end)', 5)} as stress_corr from (select a.symbol as a, b.symbol as b, a.r as ra, b.r as rb, case when a.ts < timestamp '1999-01-01' then 1 else 0 end as calm from {views.returns(d)} a join {views.returns(d)} b on a.ts = b.ts and a.symbol < b.symbol where a.r is not null and b.r is not null) x group by a, b")


def entropy(d, n: int = 60, order: int = 3) -> str:
    """Entropy of ordinal patterns of three closes over a window, as a share of its maximum."""
    s = Series(d)
    pats = staged(views.bars(d), {"c1": s.lag("close"), "c2": s.lag("close", 2)}, {"pat": "case when c2 is null then null else 4 * case when close > c1 then 1 else 0 end + 2 * case when c1 > c2 then 1 else 0 end + case when close > c2 then 1 else 0 end end"})
    counts = {f"k{k}": f"cast(count(case when pat = {k} then 1 end) {s.R(n)} as double) / {n}" for k in range(8)}
    h = " + ".join(f"case when k{k} > 0 then -k{k} * ln(k{k}) else 0 end" for k in range(8))
    return staged(pats, {"full_": f"count(pat) {s.R(n)}"} | counts, {"entropy": f"case when full_ = {n} then ({h}) / ln(cast(6 as double)) end"})


query("i02_permutation_entropy", lambda d: output(entropy(d), ("symbol", "ts"), ["entropy"]))
query("i03_entropy_features", lambda d: output(staged(entropy(d), {"lagged": Series(d).lag("entropy"), "decay": f"(entropy - {Series(d).lag('entropy', 5)}) / 5"}), ("symbol", "ts"), ["lagged", "decay"]))
query("i09_shape_features", lambda d: output(staged(f"(select symbol, ts, round(skew, 8) as skew, round(kurtosis, 8) as kurtosis from {B.moments(Series(d), views.returns(d), 60)} m)", {"shape": "case when skew is null then null when skew > 0.5 then 'P' when skew < -0.5 then 'b' when kurtosis > 1 then 'fat_tail' else 'normal' end"}), ("symbol", "ts"), ["skew", "kurtosis"], ["shape"], 8))

# ---- recall
query("r06_categorise", lambda d: "select doc_id, case when lower(text) like '%token =%' then 'secret' when lower(text) like '%license%' then 'license' when lower(text) like '%@%' then 'contact' else 'other' end as category from {documents}")


