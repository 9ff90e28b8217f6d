"""More queries: pairs of instruments, calendars, reports, sizing, comparisons and recall."""

from __future__ import annotations

from ..frames import Series, output, staged
from ..operators import bars as B
from ..operators import chains as A
from . import views
from .flow_queries import labelled
from .registry import query
from .table_queries import PERF, _r, performance, ret

ONE = "cast(1 as double)"


def pairs(d) -> str:
    """Closes and returns of two instruments on common days."""
    b = views.returns(d)
    return f"(select a.symbol as a, b.symbol as b, a.ts, a.close as ca, b.close as cb, a.r as ra, b.r as rb from {b} a join {b} b on a.ts = b.ts and a.symbol < b.symbol where a.r is not null and b.r is not null)"


PAIR = ("a", "b", "ts")
P = lambda d: Series(d, ("a", "b"))
query("b25_cross_features", lambda d: output(staged(pairs(d), {"corr_20": f"case when count(ra) {P(d).R(20)} = 20 then corr(ra, rb) {P(d).R(20)} end", "strength": "(1 + ra) / nullif(1 + rb, 0) - 1", "spread": "ca - cb"}, {"spread_z": P(d).z("spread", 20)}), PAIR, ["corr_20", "strength", "spread_z"], [], 5))
query("b27_relative_strength", lambda d: output(staged(pairs(d), {f"rs_{n}": f"(ca / {P(d).lag('ca', n)}) / nullif(cb / {P(d).lag('cb', n)}, 0)" for n in (20, 60)}, {"rs_momentum": f"rs_20 - {P(d).lag('rs_20', 5)}"}), PAIR, ["rs_20", "rs_60", "rs_momentum"], [], 5))
query("b32_ratio_dynamics", lambda d: output(staged(pairs(d), {"ratio": "ca / cb"}, {"ratio_1": f"ratio / {P(d).lag('ratio')} - 1", "ratio_5": f"ratio / {P(d).lag('ratio', 5)} - 1", "ratio_z": P(d).z("ratio", 20)}), PAIR, ["ratio", "ratio_1", "ratio_5", "ratio_z"], [], 5))
query("b33_pair_correlation", lambda d: output(staged(pairs(d), {"c": f"case when count(ra) {P(d).R(20)} = 20 then corr(ra, rb) {P(d).R(20)} end"}, {"change": f"c - {P(d).lag('c', 5)}", "strong": "case when c > 0.7 then 1 when c < -0.7 then -1 else 0 end"}), PAIR, ["c", "change"], ["strong"], 5))
query("b35_beta", lambda d: output(staged(pairs(d), {"beta": f"case when count(ra) {P(d).R(20)} = 20 then greatest(-50, least(50, covar_samp(ra, rb) {P(d).R(20)} / nullif(var_samp(rb) {P(d).R(20)}, 0))) end"}, {"divergence": "case when sign(ra) * sign(rb) < 0 then 1 else 0 end"}), PAIR, ["beta"], ["divergence"], 5))
query("b34_risk_appetite", lambda d: f"select ts, {_r('avg(z)', 5)} as appetite, count(z) as ratios from {staged(staged(pairs(d), {'ratio': 'ca / cb'}), {'z': P(d).z('ratio', 60)})} x group by ts")
query("b29_cross_timeframe", lambda d: f"select w.symbol, w.ts, {_r('w.r')} as week_return, {_r('m.r')} as month_return, case when sign(w.r) = sign(m.r) then 1 else 0 end as agree from (select symbol, date_trunc('week', ts) as ts, {d.last('close', 'ts')} / {d.first('open', 'ts')} - 1 as r from {views.bars(d)} b group by symbol, date_trunc('week', ts)) w join (select symbol, date_trunc('month', ts) as ts, {d.last('close', 'ts')} / {d.first('open', 'ts')} - 1 as r from {views.bars(d)} b group by symbol, date_trunc('month', ts)) m on w.symbol = m.symbol and date_trunc('month', w.ts) = m.ts")
query("i10_shape_similarity", lambda d: f"select a.symbol as a, b.symbol as b, {_r('exp(-(abs(a.m - b.m) * 10 + abs(a.s - b.s)))')} as similarity from (select symbol, avg(r) as m, stddev_samp(r) as s from {views.returns(d)} x group by symbol) a join (select symbol, avg(r) as m, stddev_samp(r) as s from {views.returns(d)} y group by symbol) b on a.symbol < b.symbol")
query("i18_sector_correlation", lambda d: f"select ts, {_r('avg(c)', 5)} as mean_corr from {staged(pairs(d), {'c': f'case when count(ra) {P(d).R(20)} = 20 then corr(ra, rb) {P(d).R(20)} end'})} x group by ts")


def transfer_entropy(d) -> str:
    """Transfer entropy between all ordered pairs: returns in three bins by terciles, one step of history."""
    bins = f"(select symbol, ts, ntile(3) over (partition by symbol order by r, ts) as k, lead(ts) over (partition by symbol order by ts) as nxt from {views.returns(d)} x where r is not null)"
    nxt = f"(select a.symbol, a.ts, a.k, b.k as k1 from {bins} a join {bins} b on a.symbol = b.symbol and a.nxt = b.ts)"
    rows = f"(select x.symbol as target, y.symbol as source, x.k1, x.k as x0, y.k as y0 from {nxt} x join {bins} y on x.ts = y.ts and x.symbol <> y.symbol)"
    n = f"(select target, source, k1, x0, y0, cast(count(*) as double) as c from {rows} r group by target, source, k1, x0, y0)"
    p = staged(n, {"n": "sum(c) over (partition by target, source)", "c_xy": "sum(c) over (partition by target, source, x0, y0)", "c_1x": "sum(c) over (partition by target, source, k1, x0)", "c_x": "sum(c) over (partition by target, source, x0)"})
    return f"(select source, target, sum(c / n * log2(c * c_x / (c_xy * c_1x))) as te from {p} q group by source, target)"


query("i04_transfer_entropy", lambda d: f"select source, target, {_r('te')} as te from {transfer_entropy(d)} t")
query("i06_net_flow", lambda d: f"select a.source as a, a.target as b, {_r('a.te - b.te')} as net, case when a.te - b.te > 0.01 then 'a' when a.te - b.te < -0.01 then 'b' else 'none' end as dominant from {transfer_entropy(d)} a join {transfer_entropy(d)} b on a.source = b.target and a.target = b.source where a.source < a.target")


def wasserstein(d) -> str:
    """Distance between the values of two instruments: the gap between their distribution functions, over all steps of either."""
    values = f"(select symbol, round(r, 9) as v, row_number() over (partition by symbol order by r, ts) as k, count(*) over (partition by symbol) as n from {views.returns(d)} x where r is not null)"
    keys = f"(select distinct a, b from {pairs(d)} z)"
    side = lambda key, k: f"select p.a, p.b, {k} as side, u.v, u.k, u.n from {keys} p join {values} u on u.symbol = p.{key}"
    over = "over (partition by a, b order by v, side, k)"
    steps = staged(f"({side('a', 0)} union all {side('b', 1)})", {"fa": f"sum(case when side = 0 then {ONE} / n else 0 end) {over}", "fb": f"sum(case when side = 1 then {ONE} / n else 0 end) {over}", "step": f"coalesce(lead(v) {over} - v, 0)"})
    return f"select a, b, {_r('sum(abs(fa - fb) * step)', 5)} as distance from {steps} q group by a, b"


query("i08_wasserstein", wasserstein)

# ---- calendars and joins
CAL = "(select o_orderdate as due, count(*) as n from {orders} group by o_orderdate)"


def near_events(d, first: int, last: int) -> str:
    """Bars with the events from `first` to `last` days after them: each event goes to the days whose window it is in."""
    days = f"(select due, n, {d.explode(d.series(str(-last), str(-first)), 'k')} from {CAL} c)"
    dated = f"(select cast(due as date) as due, n, cast({d.plus_days('due', 'k')} as date) as day from {days} e)"
    return f"(select b.symbol, b.ts, e.n, {d.days('e.due', 'cast(b.ts as date)')} as ahead from (select *, cast(ts as date) as day from {views.bars(d)} x) b join {dated} e on b.day = e.day)"


query("c16_event_windows", lambda d: f"select symbol, ts, cast(sum(n) as bigint) as events, min(ahead) as nearest_ahead from {near_events(d, -2, 3)} x group by symbol, ts")
query("c17_upcoming_events", lambda d: f"select symbol, ts, min(ahead) as days_until, case when min(ahead) <= 1 then 1 else 0 end as tighten from {near_events(d, 0, 4)} x group by symbol, ts")
query("j11_array_members", lambda d: f"select user_id, member, count(*) as n from (select user_id, {d.explode('ids', 'member')} from (select user_id, {d.collect('event_type')} as ids from {{events}} group by user_id) x) y group by user_id, member")

# ---- reports
query("a03_resample_contract", lambda d: f"select symbol, dte, opt, date_trunc('month', ts) as ts, sum(opt_volume) as volume, max(oi) as top_oi from {views.chain(d)} c group by symbol, dte, opt, date_trunc('month', ts)")
query("a17_regime_timeline", lambda d: f"select ts, min(top) as label, sum(n) as symbols from (select ts, n, first_value(label) over (partition by ts order by n desc, label) as top from (select ts, label, count(*) as n from {labelled(d)} l group by ts, label) x) y group by ts")
query("a19_fragility_report", lambda d: f"select symbol, {_r('dev * sqrt(252.0)', 5)} as vol, rank_vol from (select symbol, dev, rank() over (order by dev desc) as rank_vol from (select symbol, stddev_samp(r) as dev from {views.returns(d)} x group by symbol) y) z")
query("a26_regime_coverage", lambda d: f"select s.strategy, s.regime, coalesce(t.n, 0) as n, case when t.n is null then 1 else 0 end as gap from (select a.strategy, b.regime from (select distinct strategy from {views.trades(d)} x) a cross join (select distinct regime from {views.trades(d)} y) b) s left join (select strategy, regime, count(*) as n from {views.trades(d)} c group by strategy, regime) t on s.strategy = t.strategy and s.regime = t.regime")
query("a30_day_summary", lambda d: f"select l_shipdate as day, {d.counts(chr(39) + 'O' + chr(39) + ' = l_linestatus')} as filled, {_r('sum(l_extendedprice)', 3)} as gross, {_r('sum(l_extendedprice * l_tax)', 6)} as fees from {{lineitem}} group by l_shipdate")
query("a33_exposure_snapshot", lambda d: f"select symbol, ts, {_r('net_gex', 3)} as net_gex, position from (select *, row_number() over (partition by symbol order by ts desc) as k from {A.exposure_totals(views.chain(d))} e) x where k = 1")
query("a35_key_runs", lambda d: f"select strategy, {d.last('trade_id', 'pnl', 'trade_id')} as best, {d.first('trade_id', 'pnl', 'trade_id')} as worst, {d.last('trade_id', 'entry', 'trade_id')} as latest from {views.trades(d)} t group by strategy")
query("a37_goal_progress", lambda d: f"select strategy, goal, best, case when best >= goal then 1 else 0 end as met from (select strategy, {_r('max(pnl)', 4)} as best, 240000.0 as goal from {views.trades(d)} t group by strategy) x".replace("240000.0", "cast(240000 as double)"))
query("a38_graduation_ready", lambda d: f"select strategy, n, {_r('sharpe')} as sharpe, {_r('win_rate')} as win_rate, case when n >= 50 and sharpe > 0 and win_rate >= 0.5 then 1 else 0 end as ready from (select strategy, count(*) as n, avg(pnl) / nullif(stddev_samp(pnl), 0) as sharpe, avg(case when pnl > 0 then {ONE} else 0 end) as win_rate from {views.trades(d)} t group by strategy) x")

# ---- evaluation
query("e05_threshold_sharpe", lambda d: f"select symbol, p, n, {_r('mean / nullif(dev, 0) * sqrt(252.0)', 5)} as sharpe, {_r('mean / nullif(dev / sqrt(n), 0)', 5)} as t from (select symbol, p, count(*) as n, avg(nxt) as mean, stddev_samp(nxt) as dev from (select symbol, nxt, pct, {d.explode(d.series('1', '9'), 'p')} from (select symbol, lead(r) over (partition by symbol order by ts) as nxt, ntile(10) over (partition by symbol order by r, ts) as pct, r from {views.returns(d)} x where r is not null) y) z where nxt is not null and pct > p group by symbol, p) w")


def embargoed(d, before: int = 3, after: int = 3) -> str:
    """Bars that are not within some days of a quarter's start; the days around each start are joined by equality."""
    starts = f"(select distinct cast(date_trunc('quarter', ts) as date) as edge from {views.bars(d)} q)"
    days = f"(select distinct cast({d.plus_days('edge', 'k')} as date) as day from (select edge, {d.explode(d.series(str(-before), str(after)), 'k')} from {starts} s) t)"
    return f"select b.symbol, b.ts, b.close from {views.bars(d)} b left join {days} e on cast(b.ts as date) = e.day where e.day is null"


query("e07_embargo", embargoed)
query("e08_signal_quality", lambda d: f"select symbol, {d.counts('trade = 1 and position = 1')} as entries, {_r('avg(case when position = 1 then case when r > 0 then 1 else 0 end end)')} as hit_rate, {_r('avg(case when position = 1 then r end)')} as mean, {_r('stddev_samp(case when position = 1 then r end)')} as dev from {B.momentum_backtest(Series(d), views.bars(d))} m group by symbol".replace("then 1 else 0 end end", f"then {ONE} else 0 end end"))
query("e12_portfolio_metrics", lambda d: f"select {_r('sum(pnl)', 2)} as total, {_r('min(equity - peak)', 2)} as max_drawdown, {_r('max(pnl)', 2)} as best_day, {_r('min(pnl)', 2)} as worst_day from (select *, max(equity) over (order by entry rows between unbounded preceding and current row) as peak from (select *, sum(pnl) over (order by entry rows between unbounded preceding and current row) as equity from (select entry, sum(pnl) as pnl from {views.trades(d)} t group by entry) d) e) f")
query("e19_combine_signals", lambda d: f"select symbol, ts, up + trend as votes, case when up = trend then up else 0 end as unanimous from (select symbol, ts, case when close > sma_10 then 1 else -1 end as up, case when sma_10 > sma_50 then 1 else -1 end as trend from {B.sma(Series(d), views.bars(d))} x where sma_50 is not null) y")
query("e18_breakout_signals", lambda d: f"select symbol, ts, case when breakout_up = 1 then 1 when breakout_down = 1 then -1 else 0 end as breakout, case when up_score >= 8 then 1 when down_score >= 8 then -1 else 0 end as momentum from {B.structure(Series(d), views.bars(d))} s")
query("e21_regime_filtered", lambda d: f"select symbol, label, count(*) as n, {_r('avg(nxt)')} as held, {_r('avg(case when up = 1 then nxt else 0 end)')} as filtered from (select symbol, label, lead(close) over (partition by symbol order by ts) / close - 1 as nxt, case when close > lag(close, 5) over (partition by symbol order by ts) then 1 else 0 end as up from {labelled(d)} l) x where nxt is not null group by symbol, label")
query("e23_walk_forward", lambda d: f"select symbol, year(ts) as year_, count(r) as n, {_r('avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0)', 5)} as sharpe from {ret(d)} x group by symbol, year(ts)")
query("e27_regression_compare", lambda d: f"select a.symbol, b.symbol as base, {_r('a.sharpe - b.sharpe', 5)} as sharpe_delta, case when a.sharpe >= b.sharpe then 'better' else 'worse' end as verdict from {performance(d, ret(d))} a join {performance(d, ret(d))} b on a.symbol <> b.symbol where b.symbol = 'ECONOMY'")
query("e37_contribution", lambda d: f"select a, {_r('avg(c)', 5)} as mean_corr from (select a, b, corr(ra, rb) as c from {pairs(d)} p group by a, b) x group by a")
query("e39_fitness", lambda d: output(staged(performance(d, ret(d)), {"fitness": "least(greatest(sharpe, -3), 3) * 0.4 + least(greatest(sortino, -3), 3) * 0.2 + win_rate * 0.2 + max_dd * 0.2"}), ("symbol",), ["fitness"], [], 5))
query("e43_position_sizing", lambda d: f"select symbol, ts, {_r('least(1, 0.15 / nullif(rv_20, 0))', 5)} as size from {B.realized_vol(Series(d), views.bars(d))} v where rv_20 is not null")
query("e45_kelly", lambda d: output(staged(performance(d, ret(d)), {"kelly": "greatest(0, least(0.25, mean / nullif(dev * dev, 0)))"}), ("symbol",), ["kelly"], [], 5))
query("e46_drawdown_state", lambda d: f"select symbol, ts, {_r('drawdown', 5)} as drawdown, case when drawdown < -0.10 then 'halt' when drawdown < -0.05 then 'reduce' else 'normal' end as action from {B.momentum_backtest(Series(d), views.bars(d))} m")
query("e58_time_exits", lambda d: f"select profile, count(*) as trades, {_r('sum(pnl)', 2)} as pnl from {views.paths(d)} p where day = case profile when 'A' then 1 when 'N' then 2 else 3 end group by profile")
query("e71_missed_peaks", lambda d: f"select trade_id, {_r('max(pnl) - ' + d.last('pnl', 'day'), 4)} as missed, max(day) - {d.first('day', '-pnl', 'day')} as days_missed from {views.paths(d)} p group by trade_id")
query("e57_filter_impact", lambda d: f"select kept, count(*) as trades, {d.counts('peak <= 20')} as peakless from (select trade_id, max(pnl) as peak, max(case when day = 1 and spot < 3000 then 1 else 0 end) as kept from {views.paths(d)} p group by trade_id) x group by kept")
query("e60_stop_levels", lambda d: f"select symbol, ts, {_r('close - 2 * atr_14', 5)} as stop_long, {_r('close + 2 * atr_14', 5)} as stop_short from {B.atr(Series(d), views.bars(d))} a where atr_14 is not null")
query("e66_concentration", lambda d: f"select l_returnflag as grp, {_r('cast(sum(l_quantity) as double) / sum(sum(l_quantity)) over ()')} as share from {{lineitem}} group by l_returnflag")
query("e64_position_greeks", lambda d: f"select symbol, ts, {_r('sum(case when opt = ' + chr(39) + 'C' + chr(39) + ' then delta else -delta end)', 5)} as net_delta, {_r('sum(gamma)', 8)} as net_gamma, {_r('sum(theta)', 5)} as net_theta from {A.greeks(views.chain(d))} g where dte = 30 group by symbol, ts")

# ---- recall and ordering
query("r07_provenance", lambda d: "select conv_id, turn, role, length(text) as n from (select *, row_number() over (partition by conv_id order by turn desc) as k from {conversations}) c where k <= 2")
query("z02_topk_edge", lambda d: f"select symbol, ts, {_r('r')} as r from {views.returns(d)} x where r is not null order by round(abs(x.r), 9) desc, symbol, ts limit 25")
query("z03_first_rule", lambda d: f"select symbol, ts, case when r > 0.5 then 'spike' when r < -0.3 then 'drop' when volume > 150 then 'busy' else 'none' end as rule from {views.returns(d)} x")
query("z04_union_counts", lambda d: "select 'events' as source, count(*) as n from {events} union all select 'orders', count(*) from {orders} union all select 'documents', count(*) from {documents}")
query("e67_batch_significance", lambda d: output(staged(performance(d, ret(d)), {"rank_t": "row_number() over (order by round(t_stat, 6) desc, symbol)"}), ("symbol",), PERF[:4], ["rank_t"], 5))
