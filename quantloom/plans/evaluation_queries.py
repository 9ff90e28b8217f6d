"""Queries of factors, significance, rule searches, legs and paths, sizing, portfolios and playbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..frames import DUCK, SPARK, Dialect, Series, output, staged
from ..operators import bars as B
from ..operators import chains as A
from ..operators import evaluation as E
from ..operators import factors
from ..sources.shared import stored
from . import views
from .flow_queries import labelled
from .information_queries import returned
from .more_queries import pairs
from .registry import bound, native, query, relation, spark_stored
from .table_queries import performance

DAY = ("symbol", "ts")
ONE = E.ONE
LOOKBACKS = (5, 10, 20, 60)


# ---- factors and features
def features(d: Dialect) -> str:
    """Bars with a few features known at their close, the next return and its sign."""
    s = Series(d)
    rows = staged(
        returned(d),
        {"mom_5": f"close / {s.lag('close', 5)} - 1", "mom_20": f"close / {s.lag('close', 20)} - 1", "vol_20": s.roll("stddev_samp", "r", 20), "volume_ratio": f"volume / {s.roll('avg', 'volume', 20)}", "next_r": s.lead("r"), "i": f"row_number() {s.W}"},
        {"target": "case when next_r > 0 then 1 when next_r is not null then 0 end", "year_": "year(ts)"},
    )
    return f"(select * from {rows} f where mom_20 is not null and vol_20 is not null and volume_ratio is not null)"


FEATURES = ("mom_5", "mom_20", "vol_20", "volume_ratio")
#: Formulas over x0 .. x3, the features in order.
EQUATIONS = {"f_trend": "sign(x1) * sqrt(abs(x1)) / (x2 + 0.001)", "f_reversal": "-x0 / x2 + log(x3)", "f_mixed": "square(x1) - 0.5 * exp(-x3) + sin(x0)", "f_guarded": "sqrt(x0) + log(x1)"}


def factored(d: Dialect) -> str:
    """Formulas over the features, and expanding z-scores of the first of them."""
    s = Series(d)
    rows = factors.factor_columns(features(d), EQUATIONS, {f"x{k}": f for k, f in enumerate(FEATURES)})
    return staged(rows, {"z_trend": f"case when count(f_trend) {s.B} >= 60 then (f_trend - avg(f_trend) {s.B}) / greatest(stddev_samp(f_trend) {s.B}, 1e-10) end"})


query("e01_factor_columns", lambda d: output(factored(d), DAY, [*EQUATIONS, "z_trend"], [], 6))
query("z07_user_formula", lambda d: output(factors.factor_columns(features(d), {"score": "(x1 - x0) / (square(x2) + 0.0001) * cos(x3)"}, {f"x{k}": f for k, f in enumerate(FEATURES)}), DAY, ["score"], [], 5))
def ranked(d: Dialect) -> str:
    """Features by the information they share with the next return's sign."""
    rows = f"(select target, {', '.join(FEATURES)}, row_number() over (partition by symbol order by ts) * 1000 + length(symbol) as i from {features(d)} f)"
    return staged(f"(select feature, n, round(bits, 7) as bits from {E.mutual_information(rows, FEATURES)} m)", {"rank_": "row_number() over (order by bits desc, feature)"})


query("e36_feature_ranking", lambda d: output(ranked(d), ("feature",), ["bits"], ["n", "rank_"], 7))


# ---- significance
def signalled(d: Dialect) -> str:
    """A row's number in its series, yesterday's momentum as a signal, and the return as the outcome."""
    s = Series(d)
    rows = staged(returned(d), {"signal": f"sign(close / {s.lag('close', 20)} - 1)"}, {"before": s.lag("signal")})
    return f"(select symbol, row_number() over (partition by symbol order by ts) as i, before as signal, r as outcome from {rows} x where before is not null)"


def hit_or_miss(d: Dialect) -> str:
    """Whether yesterday's momentum was up, and whether the return was."""
    return f"(select symbol, case when signal > 0 then 1 else 0 end as hit, case when outcome > 0 then 1 else 0 end as label from {signalled(d)} h0)"


query("e30_permutation_test", lambda d: output(E.permutation_test(d, hit_or_miss(d)), ("symbol",), ["expected", "p_value"], ["observed", "n", "tp", "fp", "fn", "tn"], 7))
query("e31_bootstrap", lambda d: output(E.bootstrap(d, hit_or_miss(d)), ("symbol",), ["spread", "p_below"], ["tp", "fp", "low", "middle"], 6))


def noise(d: Dialect, paths: int = 20) -> str:
    """Sharpe of the momentum strategy on walks of shuffled returns; a mean above 0.5 speaks for looking ahead."""
    rows = f"(select symbol, r, row_number() over (partition by symbol order by ts) as i from {returned(d)} x)"
    walks = f"(select symbol, seed, r, row_number() over (partition by symbol, seed order by {E.mixed('i', 'seed')}, i) as i from (select *, {d.explode(d.series('1', str(paths)), 'seed')} from {rows} y) z)"
    s = Series(d, ("symbol", "seed"), ("i",))
    steps = staged(walks, {"level": f"exp(sum(ln(greatest(1 + r, 1e-6))) {s.U})"}, {"momentum": f"level / {s.lag('level', 20)} - 1"}, {"held": f"case when {s.lag('momentum')} > 0 then r when {s.lag('momentum')} is not null then 0 end"})
    sharpes = f"(select symbol, seed, avg(held) / nullif(stddev_samp(held), 0) * sqrt(252.0) as sharpe from {steps} w group by symbol, seed)"
    return f"(select symbol, count(*) as paths, avg(sharpe) as mean_sharpe, max(sharpe) as best, avg(case when sharpe > 0.5 then {ONE} else 0 end) as above from {sharpes} q group by symbol)"


query("e56_noise_control", lambda d: output(noise(d), ("symbol",), ["mean_sharpe", "best", "above"], ["paths"], 5))


def indicators(d: Dialect) -> str:
    """Directional accuracy, Sharpe, drawdown, win rate and information ratio of the momentum strategy."""
    s = Series(d)
    rows = staged(B.momentum_backtest(s, views.bars(d)), {"guess": f"sign({s.lag('momentum')})", "wealth": f"exp(sum(ln(greatest(1 + strategy_return, 1e-9))) {s.U})"}, {"top": f"max(wealth) {s.U}", "excess": "strategy_return - coalesce(r, 0)"})
    return f"(select symbol, count(r) as n, avg(case when guess <> 0 then case when guess = sign(r) then {ONE} else 0 end end) as accuracy, sqrt(252.0) * avg(strategy_return) / nullif(stddev_pop(strategy_return), 0) as sharpe, min(wealth / top - 1) as max_dd, {ONE} * sum(case when strategy_return > 0 then 1 else 0 end) / nullif(sum(case when strategy_return <> 0 then 1 else 0 end), 0) as win_rate, sqrt(252.0) * avg(excess) / nullif(stddev_pop(excess), 0) as information_ratio from {rows} x group by symbol)"


query("e29_overfit_indicators", lambda d: output(staged(indicators(d), {"suspicious": "case when accuracy > 0.65 or sharpe > 3 or max_dd > -0.01 then 1 else 0 end"}), ("symbol",), ["accuracy", "sharpe", "max_dd", "win_rate", "information_ratio"], ["n", "suspicious"], 5))


# ---- rules over trades
def entries(d: Dialect) -> str:
    """Trades with what is known at their entry, their peak and final profit, and whether they never had one."""
    if d.spark:  # both from one grouping
        own = lambda x: f"max(case when day = 1 then {x} end)"
        whole = f"(select trade_id, {own('profile')} as profile, {own('spot')} as spot, {own('date')} as date, {own('pnl')} as first_pnl, max(pnl) as peak, {d.last('pnl', 'day')} as final_pnl, max(day) as days from {views.paths(d)} p where trade_id is not null group by trade_id)"
        return f"(select trade_id as i, profile, spot, first_pnl, day(date) as day_of_month, month(date) as month_, year(date) as year_, peak, final_pnl, case when peak <= 20 then 1 else 0 end as label, case when final_pnl > 0 then 1 else 0 end as winner from {whole} w)"
    first = f"(select trade_id, profile, spot, date, pnl as first_pnl from {views.paths(d)} p where day = 1)"
    whole = f"(select trade_id, max(pnl) as peak, {d.last('pnl', 'day')} as final_pnl, max(day) as days from {views.paths(d)} q group by trade_id)"
    return f"(select f.trade_id as i, f.profile, f.spot, f.first_pnl, day(f.date) as day_of_month, month(f.date) as month_, year(f.date) as year_, w.peak, w.final_pnl, case when w.peak <= 20 then 1 else 0 end as label, case when w.final_pnl > 0 then 1 else 0 end as winner from {first} f join {whole} w on f.trade_id = w.trade_id)"


ENTRY = ("spot", "first_pnl", "day_of_month", "month_")
RULED = ("spot", "first_pnl", "month_")


def ruled(rules: str) -> str:
    return output(rules, ("feature", "pct", "direction"), ["threshold", "p_value", "p_below"], ["tp", "fp", "fn", "tn", "g1", "g2", "g3", "g4", "g5", "g6", "g7", "gates"], 5)


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over trades, in steps that are written: the trades, the rules with their counts, their tests."""
    rows = stored(relation(spark, sf_dir, entries(SPARK)), "entries")
    gates = stored(bound(spark, f"select * from {E.rule_gates(SPARK, '{rows}', RULED)} g", rows=rows), "rules")
    return bound(spark, ruled(E.rule_tests(SPARK, "{gates}")), gates=gates)


native("e32_rule_search", searched, ruled(E.rule_search(DUCK, entries(DUCK), RULED)))
query("e33_winner_loser_tests", lambda d: output(f"(select * from {E.group_tests(d, entries(d), ('profile',), ENTRY)} t where rank_ <= 3)", ("profile", "feature"), ["m1", "m0", "t", "p", "effect"], ["n1", "n0", "significant", "rank_"], 5))


def two_rules(d: Dialect, rows: str) -> str:
    """Both of two percentile rules at once: counts of alarms and labels, and the years in which true ones prevail."""
    if d.spark:
        return _two_rules_counted(rows)
    cuts = lambda f: " union all ".join(f"select {p} as p_{f}, {d.quantile(f, p / 100)} as c_{f} from {rows} q{p}" for p in (25, 50, 75))
    grid = f"(select * from ({cuts('spot')}) a cross join ({cuts('first_pnl')}) b)"
    both = f"(select g.p_spot, g.p_first_pnl, e.year_, e.label, case when e.spot <= g.c_spot and e.first_pnl <= g.c_first_pnl then 1 else 0 end as hit from {rows} e cross join {grid} g)"
    yearly = f"(select p_spot, p_first_pnl, year_, sum(hit * label) as tp, sum(hit * (1 - label)) as fp, sum((1 - hit) * label) as fn from {both} x group by p_spot, p_first_pnl, year_)"
    return f"(select p_spot, p_first_pnl, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(case when tp >= fp then 1 else 0 end) as good_years, count(*) as years from {yearly} y group by p_spot, p_first_pnl)"


def _two_rules_counted(rows: str) -> str:
    """The same from counts of trades of one year and label between the same limits."""
    limits = E.sorted_quantiles(E.unpivot(rows, ("label",), ("spot", "first_pnl")), ("feature",), (25, 50, 75))
    ranked = f"(select *, size(filter(array_agg(threshold) over (partition by feature), x -> x < threshold)) as lower from {limits} t)"
    side = lambda f: f"select pct as p_{f}, lower as l_{f} from {ranked} r_{f} where feature = '{f}'"
    lines = f"(select array_agg(case when feature = 'spot' then threshold end) as ts, array_agg(case when feature = 'first_pnl' then threshold end) as tf from {limits} t)"
    under = lambda x, ts: f"case when {x} is not null then size(filter({ts}, t -> t < {x})) else 9 end"
    cells = f"(select e.year_, e.label, {under('e.spot', 'k.ts')} as u_spot, {under('e.first_pnl', 'k.tf')} as u_first_pnl from {rows} e cross join {lines} k)"
    cells = f"(select year_, label, u_spot, u_first_pnl, count(*) as m from {cells} c group by year_, label, u_spot, u_first_pnl)"
    both = f"(select a.p_spot, b.p_first_pnl, c.year_, c.label, c.m, case when c.u_spot <= a.l_spot and c.u_first_pnl <= b.l_first_pnl then 1 else 0 end as hit from {cells} c cross join ({side('spot')}) a cross join ({side('first_pnl')}) b)"
    yearly = f"(select p_spot, p_first_pnl, year_, sum(m * hit * label) as tp, sum(m * hit * (1 - label)) as fp, sum(m * (1 - hit) * label) as fn from {both} x group by p_spot, p_first_pnl, year_)"
    return f"(select p_spot, p_first_pnl, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn, sum(case when tp >= fp then 1 else 0 end) as good_years, count(*) as years from {yearly} y group by p_spot, p_first_pnl)"


# trades are read several times: Spark writes them first
spark_stored("e54_two_feature_rules", entries, lambda d, rows: output(two_rules(d, rows), ("p_spot", "p_first_pnl"), [], ["tp", "fp", "fn", "good_years", "years"]))


def separation(d: Dialect) -> str:
    """Distances between groups of trades in standardised features."""
    long = E.unpivot(entries(d), ("profile",), ENTRY)
    scaled = f"(select profile, feature, (value - avg(value) over (partition by feature)) / nullif(stddev_samp(value) over (partition by feature), 0) as z from {long} l)"
    group = f"(select profile, feature, count(*) as n, avg(z) as m, var_samp(z) as v from {scaled} s group by profile, feature)"
    return f"(select a.feature, a.profile as a, b.profile as b, a.m - b.m as gap, (a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0) as t from {group} a join {group} b on a.feature = b.feature and a.profile < b.profile)"


query("e70_separation_tests", lambda d: output(staged(separation(d), {"p": E.two_sided("t")}), ("feature", "a", "b"), ["gap", "t", "p"], [], 5))


def trailing(d: Dialect) -> str:
    """Trades closed when their profit falls a trail below a peak that has passed the activation, against a fixed day."""
    s = Series(d, ("trade_id",), ("day",))
    rows = staged(views.paths(d), {"top": f"max(pnl) {s.U}"}, {"stopped": "case when top >= 150 and pnl <= top - 100 then day end"})
    base = f"(select trade_id, min(date) as date, max(pnl) as peak, min(stopped) as stop_day, max(day) as days from {rows} r group by trade_id)"
    exits = f"(select b.trade_id, year(b.date) as year_, b.peak, max(case when r.day = coalesce(b.stop_day, b.days) then r.pnl end) as rule_pnl, max(case when r.day = least(3, b.days) then r.pnl end) as fixed_pnl, max(case when b.stop_day is not null then 1 else 0 end) as fired from {base} b join {rows} r on b.trade_id = r.trade_id group by b.trade_id, year(b.date), b.peak)"
    return f"(select coalesce(cast(year_ as varchar(10)), 'all') as year_, count(*) as trades, sum(case when fired = 1 and rule_pnl >= fixed_pnl then 1 else 0 end) as tp, sum(case when fired = 1 and rule_pnl < fixed_pnl then 1 else 0 end) as fp, sum(rule_pnl - fixed_pnl) as gain, 100.0 * sum(rule_pnl) / nullif(sum(greatest(peak, 0)), 0) as captured from {exits} e group by rollup(year_))"


query("e52_exit_rule_comparison", lambda d: output(trailing(d), ("year_",), ["gain", "captured"], ["trades", "tp", "fp"], 3))


# ---- legs
def days(d: Dialect) -> str:
    """Closes as spots, and the days that follow."""
    s = Series(d)
    return staged(f"(select symbol, ts, close as spot from {views.bars(d)} b)", {"next_ts": s.lead("ts"), "next_spot": s.lead("spot")})


LEGS = ("symbol", "ts", "structure", "leg")
query("e62_build_legs", lambda d: output(E.build_legs(days(d)), LEGS, ["strike"], ["opt", "qty", "dte"], 4))


def valued(d: Dialect) -> str:
    """Value of each structure at entry, and what it pays at the last close before it expires."""
    legs = d.fence(A.greeks(E.build_legs(days(d), structures=("long_straddle", "short_strangle", "iron_condor", "call_debit_spread"))), "symbol", "ts", "structure", "opt", "qty", "strike", "dte", "price")
    # the close that holds at an expiry: bars and expiries in one order, the last close carried on
    expiry = f"(select distinct symbol, ts, {d.plus_days('ts', 30)} as due from {days(d)} e)"
    line = f"(select symbol, cast(due as timestamp) as due, ts, cast(null as double) as close, 1 as kind from {expiry} x union all select symbol, cast(ts as timestamp) as due, ts, spot as close, 0 as kind from {days(d)} y)"
    held = f"(select symbol, ts, kind, {d.last_seen('close')} over (partition by symbol order by due, kind, ts rows between unbounded preceding and current row) as final from {line} l)"
    return f"(select g.symbol, g.ts, g.structure, count(*) as legs, sum(g.qty * g.price * 100) as entry_value, sum(g.qty * 100 * case when g.opt = 'C' then greatest(h.final - g.strike, 0) else greatest(g.strike - h.final, 0) end) as expiry_value from {legs} g join {held} h on g.symbol = h.symbol and g.ts = h.ts where h.kind = 1 group by g.symbol, g.ts, g.structure)"


query("e42_multi_leg_value", lambda d: output(staged(valued(d), {"profit": "expiry_value - entry_value"}), ("symbol", "ts", "structure"), ["entry_value", "expiry_value", "profit"], ["legs"], 3))


def marked(d: Dialect, longest: int = 5) -> str:
    """Straddles marked on the days after entry: longs at the bid, shorts at the ask, until a quote is missing or they expire."""
    numbered = f"(select symbol, ts, spot, row_number() over (partition by symbol order by ts) as n from {days(d)} x)"
    legs = f"(select l.*, e.n from {E.build_legs(numbered.replace('select symbol, ts, spot,', 'select symbol, ts, spot,'), structures=('long_straddle', 'short_strangle'))} l join {numbered} e on l.symbol = e.symbol and l.ts = e.ts)"
    later = f"(select *, {d.explode(d.series('0', str(longest)), 'k')} from {legs} l)"
    marks = f"(select l.symbol, l.ts, l.structure, l.opt, l.qty, l.strike, l.iv, l.k, b.spot, l.dte - {d.days('b.ts', 'l.ts')} as dte from {later} l join {numbered} b on l.symbol = b.symbol and b.n = l.n + l.k)"
    priced = d.fence(A.greeks(f"(select * from {marks} m where dte > 0)"), "symbol", "ts", "structure", "qty", "k", "price")
    leg = f"(select *, price * (1 - 0.01 * sign(qty) * case when k = 0 then -1 else 1 end) as fill from {priced} p)"
    total = f"(select symbol, ts, structure, k, count(*) as legs, sum(qty * fill * 100) as value from {leg} q group by symbol, ts, structure, k)"
    s = Series(d, ("symbol", "ts", "structure"), ("k",))
    rows = staged(total, {"entry_value": f"first_value(value) {s.W}", "fewest": f"min(legs) {s.U}"}, {"pnl": "value - entry_value"}, {"top": f"max(pnl) {s.U}"})
    return f"(select * from {rows} r where fewest = 2)"


query("e65_mark_to_market", lambda d: output(staged(marked(d), {"drawdown": "pnl - top"}), ("symbol", "ts", "structure", "k"), ["pnl", "drawdown"], [], 3))


def intraday(d: Dialect) -> str:
    """A straddle bought at a day's first tick and marked at each of its ticks: the best profit, when, and the worst fall."""
    order = ", ".join(views.TIE)
    ticks = f"(select symbol, ts, price as spot, row_number() over (partition by symbol, ts order by {order}) as n, first_value(price) over (partition by symbol, ts order by {order}) as first_price from {views.ticks(d)} t)"
    legs = f"(select symbol, ts, n, spot, opt, 7 as dte, floor(first_price + 0.5) as strike, cast(0.25 as double) as iv from {ticks} t cross join (select 'C' as opt union all select 'P') o)"
    priced = d.fence(A.greeks(legs), "symbol", "ts", "n", "price")
    s = Series(d, DAY, ("n",))
    rows = staged(f"(select symbol, ts, n, sum(price) as value from {priced} p group by symbol, ts, n)", {"pnl": f"100 * (value - first_value(value) {s.W})"}, {"top": f"max(pnl) {s.U}"})
    return f"(select symbol, ts, count(*) as marks, max(pnl) as peak, {d.first('n', '-round(pnl, 6)', 'n')} as peak_tick, min(pnl - top) as drawdown, {d.last('pnl', 'n')} as final_pnl from {rows} r group by symbol, ts)"


query("e55_intraday_paths", lambda d: output(intraday(d), DAY, ["peak", "drawdown", "final_pnl"], ["marks", "peak_tick"], 3))


def attributed(d: Dialect) -> str:
    """The call nearest to spot of each day's 30-day expiry, and what moved its price since the day before."""
    near = f"(select *, {d.days('ts', d.plus_days('ts', 0))} as zero_, row_number() over (partition by symbol, ts order by abs(strike - spot), strike) as k from {views.chain(d)} c where dte = 30 and opt = 'C')"
    priced = d.fence(A.greeks(f"(select * from {near} n where k = 1)"), "symbol", "ts", "spot", "iv", "price", "delta", "gamma", "theta", "vega")
    first = f"(select symbol as s0, min(ts) as t0 from {days(d)} x group by symbol)"
    return E.attribution(Series(d), f"(select p.*, {d.days('p.ts', 'f.t0')} as days from {priced} p join {first} f on p.symbol = f.s0)")


query("e63_pnl_attribution", lambda d: output(attributed(d), DAY, ["d_price", "delta_part", "gamma_part", "theta_part", "vega_part", "explained"], [], 4))


# ---- sizing and risk
def sized(d: Dialect) -> str:
    """Positions by signal strength, volatility target, regime and drawdown, each capped, and their cumulative cap a day."""
    s = Series(d)
    rows = staged(B.momentum_backtest(s, B.realized_vol(s, views.bars(d))), {"signal": f"greatest(-1, least(1, {s.lag('momentum')} / 0.2))", "scale": f"least(2.0, 0.15 / nullif({s.lag('rv_20')}, 0))", "regime": f"case when {s.lag('rv_20')} > 1 then 0.5 else 1.0 end", "fall": s.lag("drawdown")})
    rows = staged(rows, {"size": "greatest(-0.25, least(0.25, 0.2 * signal * scale * regime * case when fall < -0.10 then 0.0 when fall < -0.05 then 0.5 else 1.0 end))"})
    day = "over (partition by ts order by abs(round(size, 9)) desc, symbol rows between unbounded preceding and current row)"
    return staged(f"(select * from {rows} r where size is not null)", {"used": f"sum(abs(size)) {day}"}, {"allowed": "case when used <= 1.0 then size else sign(size) * greatest(0, abs(size) - (used - 1.0)) end"})


query("e43_sized_positions", lambda d: output(sized(d), DAY, ["size", "allowed"], [], 5))


def rebalanced(d: Dialect) -> str:
    """Contracts to trade from the last day's holding to the target of each day."""
    s = Series(d)
    rows = staged(sized(d), {"target": "cast(floor(100000 * allowed / close) as bigint)"}, {"current_": f"coalesce({s.lag('target')}, 0)"})
    return f"(select symbol, ts, current_ as held, target, target - current_ as trade from {rows} r where target <> current_)"


query("e45_rebalance_trades", lambda d: output(rebalanced(d), DAY, [], ["held", "target", "trade"]))
query("e61_contracts_for_rule", lambda d: f"select symbol, ts, rule, cast(greatest(1, floor(100000 * pct / (close * multiplier))) as bigint) as contracts from (select symbol, ts, close, case when r > 0.2 then 'breakout' when r < -0.2 then 'reversal' else 'carry' end as rule, case when r > 0.2 then 0.05 when r < -0.2 then 0.03 else 0.01 end as pct, case when volume > 100 then 5 else 50 end as multiplier from {returned(d)} x) y")
query("e38_convexity", lambda d: output(E.convexity(d, Series(d), f"(select symbol, ts, r from {returned(d)} x)"), ("symbol",), ["skew", "ratio", "convexity"], ["n"], 5))
query("e37_portfolio_contribution", lambda d: output(E.contribution(f"(select a, b, ts, ra, rb from {pairs(d)} p union all select b as a, a as b, ts, rb as ra, ra as rb from {pairs(d)} q)"), ("a",), ["mean_corr", "alpha", "multiplier"], [], 5))


def shocked(d: Dialect) -> str:
    """Profit of a portfolio of strategies under three shocks: allocation x sensitivity x shock, and the stress level."""
    book = f"(select strategy, {ONE} * count(*) / sum(count(*)) over () as allocation from {views.trades(d)} t group by strategy)"
    sensitivity = " union all ".join(f"select '{n}' as strategy, cast({v} as double) as vix_shock, cast({p} as double) as price_drop, cast({c} as double) as vol_crush" for n, v, p, c in (("1-URGENT", 0.8, 0.0, -0.6), ("2-HIGH", -1.2, -0.2, 0.5), ("3-MEDIUM", 0.4, 0.0, -0.3), ("4-NOT SPECIFIED", -0.3, 0.0, 0.1), ("5-LOW", 2.0, 0.3, -0.8)))
    joined = f"(select b.strategy, b.allocation, s.vix_shock, s.price_drop, s.vol_crush from {book} b join ({sensitivity}) s on b.strategy = s.strategy)"
    scenario = lambda n, size, unit, high, mid: f"select '{n}' as scenario, {size} as size, sum(allocation * {n}) * {size} / {unit} as pnl, case when {size} > {high} then 'HIGH' when {size} > {mid} then 'MEDIUM' else 'LOW' end as stress from {joined} j_{n}"
    return f"({scenario('vix_shock', 50, '100.0', 40, 20)} union all {scenario('price_drop', 10, '10.0', 15, 7)} union all {scenario('vol_crush', 30, '100.0', 40, 20)})"


query("e47_scenario_shocks", lambda d: output(shocked(d), ("scenario",), ["pnl"], ["size", "stress"], 6))
query("e48_shadow_fills", lambda d: f"select o_orderpriority as strategy, count(*) as orders, sum(case when l_linestatus = 'F' then 1 else 0 end) as filled, sum(case when l_linestatus <> 'F' then 1 else 0 end) as open_, sum(case when l_returnflag = 'R' then 1 else 0 end) as rejected, round(cast(100 as double) * sum(case when l_linestatus = 'F' then 1 else 0 end) / count(*), 4) as fill_rate, round(cast(avg(l_discount) as double), 6) as mean_slippage from {{orders}} join {{lineitem}} on o_orderkey = l_orderkey group by o_orderpriority")


# ---- portfolios
def held_weights(d: Dialect) -> str:
    """Weights by inverse volatility, set on the first day of a month and held until the next, and the day's return."""
    s = Series(d)
    rows = staged(returned(d), {"vol": s.roll("stddev_samp", "r", 20), "turn": f"case when month(ts) <> coalesce({s.lag('month(ts)')}, 0) then 1 else 0 end"}, {"raw": f"case when turn = 1 then 1 / greatest({s.lag('vol')}, 1e-6) end"}, {"kept": f"{d.last_seen('raw')} {s.U}"})
    weights = f"(select *, kept / sum(kept) over (partition by ts) as w from {rows} r where kept is not null)"
    return f"(select ts, count(*) as assets, sum(w * r) as r, max(w) as top_weight from {weights} x group by ts)"


query("e49_rebalanced_portfolio", lambda d: output(held_weights(d), ("ts",), ["r", "top_weight"], ["assets"], 6))


def weight_grid(d: Dialect) -> str:
    """The best weights of each pair and market regime for Sharpe, return and deviation, from the pair's moments."""
    rows = f"(select p.a, p.b, p.ra, p.rb, l.label from {pairs(d)} p join {labelled(d)} l on p.a = l.symbol and p.ts = l.ts)"
    moments = f"(select a, b, label, count(*) as n, avg(ra) as ma, avg(rb) as mb, var_samp(ra) as va, var_samp(rb) as vb, covar_samp(ra, rb) as c from {rows} r group by a, b, label having count(*) >= 20)"
    grid = f"(select *, k / cast(10 as double) as w from (select *, {d.explode(d.series('0', '10'), 'k')} from {moments} m) g)"
    scored = staged(grid, {"mean": "w * ma + (1 - w) * mb", "dev": "sqrt(greatest(w * w * va + (1 - w) * (1 - w) * vb + 2 * w * (1 - w) * c, 0))"}, {"sharpe": "round(mean / nullif(dev, 0) * sqrt(252.0), 9)"})
    return f"(select a, b, label, min(n) as n, {d.last('w', 'sharpe', 'k')} as best_sharpe_weight, max(sharpe) as best_sharpe, {d.last('w', 'round(mean, 12)', 'k')} as best_return_weight, {d.first('w', 'round(dev, 12)', 'k')} as least_dev_weight from {scored} s group by a, b, label)"


query("e50_weight_grid", lambda d: output(weight_grid(d), ("a", "b", "label"), ["best_sharpe_weight", "best_sharpe", "best_return_weight", "least_dev_weight"], ["n"], 5))


# ---- a book of strategies: momentum with several lookbacks on every symbol
def book(d: Dialect) -> str:
    """strategy, symbol, lookback, ts and the strategy's return."""
    s = Series(d)
    rows = staged(returned(d), {f"p_{n}": f"case when close / {s.lag('close', n)} - 1 > 0 then 1 else 0 end" for n in LOOKBACKS}, {f"r_{n}": f"r * coalesce({s.lag(f'p_{n}')}, 0)" for n in LOOKBACKS})
    one = lambda n: f"select concat(symbol, '-', '{n}') as strategy, symbol, {n} as lookback, ts, r_{n} as r, p_{n} as p from {rows} b{n}"
    return f"({' union all '.join(map(one, LOOKBACKS))})"


def validated(d: Dialect) -> str:
    """Sharpe in odd months, even months and the last year, their mean, worst drawdown and trades of each strategy."""
    s = Series(d, ("strategy",))
    rows = staged(book(d), {"part": "case when year(ts) >= 2001 then 'holdout' when month(ts) % 2 = 1 then 'train' else 'test' end", "wealth": f"exp(sum(ln(greatest(1 + r, 1e-9))) {s.U})", "turn": f"case when p = 1 and coalesce({s.lag('p')}, 0) = 0 then 1 else 0 end"}, {"top": f"max(wealth) {s.U}"})
    sharpe = lambda p: f"avg(case when part = '{p}' then r end) / nullif(stddev_samp(case when part = '{p}' then r end), 0) * sqrt(252.0) as {p}"
    base = f"(select strategy, symbol, lookback, count(*) as n, {', '.join(map(sharpe, ('train', 'test', 'holdout')))}, min(wealth / top - 1) as max_dd, sum(turn) as trades, avg(r) * 252 as annual, stddev_samp(r) * sqrt(252.0) as vol from {rows} x group by strategy, symbol, lookback)"
    return staged(base, {"sharpe": "(train + test + holdout) / 3", "survives": "case when train > 0 and test > 0 and holdout > 0 then 1 else 0 end"})


def survivors(d: Dialect) -> str:
    """Strategies that hold in all three sets, less those that repeat a better one of their symbol.

    A repeat has a neighbouring lookback and returns that correlate above 0.9 with a better survivor's.
    """
    alive = f"(select *, row_number() over (partition by symbol order by round(sharpe, 9) desc, lookback) as k from {validated(d)} v where survives = 1)"
    rows = book(d)
    near = f"(select x.strategy as strategy, y.strategy as better, corr(x.r, y.r) as c from {rows} x join {rows} y on x.symbol = y.symbol and x.ts = y.ts where x.strategy <> y.strategy group by x.strategy, y.strategy)"
    repeats = f"(select distinct a.strategy from {alive} a join {alive} b on a.symbol = b.symbol and b.k < a.k join {near} n on n.strategy = a.strategy and n.better = b.strategy where n.c > 0.9)"
    return f"(select a.* from {alive} a left join {repeats} r on a.strategy = r.strategy where r.strategy is null)"


query("e15_survivors", lambda d: output(survivors(d), ("strategy",), ["train", "test", "holdout", "sharpe", "max_dd"], ["trades"], 5))


def playbook(d: Dialect) -> str:
    """Survivors with weights by Sharpe, their stability over the sets, and the loss from train to holdout."""
    return staged(survivors(d), {"w": "greatest(sharpe, 0) / nullif(sum(greatest(sharpe, 0)) over (), 0)", "stability": "1 - (greatest(train, test, holdout) - least(train, test, holdout)) / nullif(abs(sharpe), 0)", "degradation": "1 - holdout / nullif(train, 0)"})


query("e69_playbook_table", lambda d: output(playbook(d), ("strategy",), ["w", "sharpe", "stability", "degradation", "max_dd"], ["trades", "n"], 5))


def playbook_metrics(d: Dialect) -> str:
    """Weighted Sharpe and return, deviation under independence, diversification ratio and trades a year."""
    return f"(select count(*) as strategies, sum(w * sharpe) as sharpe, sum(w * annual) as annual, sqrt(sum(w * w * vol * vol)) as vol, sum(w * vol) / nullif(sqrt(sum(w * w * vol * vol)), 0) as diversification, sum(trades) / nullif(max(n) / cast(252 as double), 0) as trades_a_year, min(max_dd) as worst_drawdown from {playbook(d)} p)"


query("e17_playbook_metrics", lambda d: output(playbook_metrics(d), ("strategies",), ["sharpe", "annual", "vol", "diversification", "trades_a_year", "worst_drawdown"], [], 5))


def fold_walk(d: Dialect, folds: int = 5) -> str:
    """The best lookback of each fold of a symbol's days, and how it does on the next fold."""
    rows = f"(select symbol, lookback, r, ntile({folds}) over (partition by strategy order by ts) as fold from {book(d)} b)"
    score = f"(select symbol, fold, lookback, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0), 9) as sharpe from {rows} x group by symbol, fold, lookback)"
    best = f"(select symbol, fold, sharpe, lookback from (select *, row_number() over (partition by symbol, fold order by sharpe desc, lookback) as k from {score} s) y where k = 1 and sharpe is not null)"
    return f"(select b.symbol, b.fold, b.lookback, b.sharpe as found, n.sharpe as tested, case when n.sharpe > 0 then 1 else 0 end as holds from {best} b join {score} n on b.symbol = n.symbol and b.lookback = n.lookback and n.fold = b.fold + 1)"


query("e68_fold_walk_forward", lambda d: output(fold_walk(d), ("symbol", "fold"), ["found", "tested"], ["lookback", "holds"], 5))


def adaptive(d: Dialect, embargo: int = 5) -> str:
    """Entry and exit thresholds from the percentiles of earlier years, and the signals of each year less its first days."""
    limits = f"(select symbol, year_ + 1 as year_, {d.quantile('mom_20', 0.7)} as enter_, {d.quantile('mom_20', 0.4)} as leave_ from {features(d)} f group by symbol, year_)"
    s = Series(d, ("symbol", "year_"))
    rows = f"(select f.symbol, f.ts, f.year_, f.mom_20, l.enter_, l.leave_ from {features(d)} f join {limits} l on f.symbol = l.symbol and f.year_ = l.year_)"
    return staged(rows, {"n": f"row_number() {s.W}", "signal": f"coalesce({d.last_seen('case when mom_20 > enter_ then 1 when mom_20 < leave_ then 0 end')} {s.U}, 0)"}, {"traded": f"case when n <= {embargo} then 0 else signal end"})


query("e59_adaptive_thresholds", lambda d: output(adaptive(d), DAY, ["mom_20", "enter_", "leave_"], ["signal", "traded"], 6))
query("e39_fitness_with_penalties", lambda d: output(E.fitness(f"(select p.*, t.trades from {performance(d, f'(select strategy, ts, r from {book(d)} b)', 'strategy')} p join (select strategy, sum(case when p = 1 then 1 else 0 end) as trades from {book(d)} c group by strategy) t on p.strategy = t.strategy)"), ("strategy",), ["weighted", "fitness"], ["trades"], 5))


def warnings(d: Dialect) -> str:
    """Warnings of the book's strategies: failing out of sample, few trades, many tests, and sensitive parameters."""
    over = "over (partition by symbol order by lookback)"
    rows = staged(validated(d), {"tests": "count(*) over ()", "t": "annual / nullif(vol, 0) * sqrt(n / 252.0)", "below": f"lag(sharpe) {over}", "above": f"lead(sharpe) {over}", "efficiency": "test / nullif(train, 0)"})
    kinds = (("data_snooping", "train > 0 and holdout < 0"), ("walk_forward_failure", "efficiency < 0.5"), ("insufficient_sample", "trades < 30"), ("multiple_testing", "abs(t) < 3"), ("parameter_sensitivity", "sharpe > 0 and least(coalesce(below, sharpe), coalesce(above, sharpe)) < 0.7 * sharpe"))
    return "(" + " union all ".join(f"select strategy, '{k}' as warning, sharpe from {rows} w{i} where {c}" for i, (k, c) in enumerate(kinds)) + ")"


query("e28_overfit_warnings", lambda d: output(warnings(d), ("strategy", "warning"), ["sharpe"], [], 5))
