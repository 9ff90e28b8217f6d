"""Option chains: Greeks as columns, exposures by strike and day, walls, structure returns.

A chain has symbol, ts, spot, strike, dte (days), opt (C or P), iv, oi, opt_volume.  Dealers are taken to be short calls
and puts alike unless `put_sign` says otherwise.  A contract with no time, volatility or price left has Greeks of 0.
"""

from __future__ import annotations

from ..frames import SPARK, Dialect, Series, staged
from .flow import normal_cdf, normal_pdf

RATE = 0.05


def greeks(source: str, rate: float = RATE) -> str:
    """Black-Scholes price, delta, gamma, vega, theta, vanna and charm of every contract."""
    ok = "t > 0 and iv > 0 and spot > 0 and strike > 0"
    zero = lambda x: f"case when valid = 1 then {x} else 0 end"
    sign = "case when opt = 'C' then 1 else -1 end"
    return staged(
        source,
        {"t": "dte / cast(365 as double)"},
        {"valid": f"case when {ok} then 1 else 0 end"},
        {"d1": f"case when valid = 1 then (ln(spot / strike) + ({rate} + iv * iv / 2) * t) / (iv * sqrt(t)) end"},
        {"d2": "d1 - iv * sqrt(t)", "pdf1": normal_pdf("d1"), "discount": f"exp(-{rate} * t)"},
        {"n1": normal_cdf("d1"), "n2": normal_cdf("d2")},
        {
            "delta": zero("case when opt = 'C' then n1 else n1 - 1 end"),
            "gamma": zero("pdf1 / nullif(spot * iv * sqrt(t), 0)"),
            "vega": zero("spot * pdf1 * sqrt(t) / 100"),
            "theta": zero(f"(-spot * pdf1 * iv / nullif(2 * sqrt(t), 0) - ({sign}) * {rate} * strike * discount * case when opt = 'C' then n2 else 1 - n2 end) / 365"),
            "vanna": zero("-pdf1 * d2 / nullif(iv, 0)"),
            "charm": zero(f"-pdf1 * (2 * {rate} * t - d2 * iv * sqrt(t)) / nullif(2 * t * iv * sqrt(t), 0) / 365"),
            "price": zero("case when opt = 'C' then spot * n1 - strike * discount * n2 else strike * discount * (1 - n2) - spot * (1 - n1) end"),
        },
    )


def exposure_by_strike(source: str, put_sign: int = -1) -> str:
    """Gamma, vanna and charm exposure of each day and strike."""
    sign = f"case when opt = 'C' then 1 else {put_sign} end"
    g = greeks(source)
    return f"(select symbol, ts, spot, strike, sum(({sign}) * gamma * oi * 100 * spot) as gex, sum(case when opt = 'C' then gamma * oi * 100 * spot else 0 end) as call_gex, sum(case when opt = 'P' then gamma * oi * 100 * spot else 0 end) as put_gex, sum(({sign}) * vanna * oi * 100) as vex, sum(({sign}) * charm * oi * 100) as cex from {g} g group by symbol, ts, spot, strike)"


def exposure_totals(source: str) -> str:
    """Sums of a day, and whether dealers are long or short gamma."""
    e = exposure_by_strike(source)
    return f"(select symbol, ts, spot, sum(gex) as net_gex, sum(call_gex) as call_gex, sum(put_gex) as put_gex, sum(vex) as net_vex, sum(cex) as net_cex, case when sum(gex) >= 0 then 'LONG_GAMMA' else 'SHORT_GAMMA' end as position from {e} e group by symbol, ts, spot)"


def walls(d: Dialect, source: str) -> str:
    """Strikes of largest call exposure above spot and put exposure below it; over all strikes if there is none."""
    e = exposure_by_strike(source)
    top = lambda x, where: f"max_by(case when {where} then strike end, case when {where} then round({x}, 6) * 1000000 - strike / 1000000 end)"
    if not d.spark:
        top = lambda x, where: f"arg_max(strike, round({x}, 6) * 1000000 - strike / 1000000) filter (where {where})"
    return f"(select symbol, ts, spot, coalesce({top('call_gex', 'strike > spot')}, {top('call_gex', '1 = 1')}) as call_wall, coalesce({top('put_gex', 'strike < spot')}, {top('put_gex', '1 = 1')}) as put_wall from {e} e group by symbol, ts, spot)"


def zero_gamma(source: str) -> str:
    """Price at which exposure summed over rising strikes first is zero or changes sign, by linear interpolation; else null."""
    e = exposure_by_strike(source)
    over = "over (partition by symbol, ts order by strike)"
    rows = staged(e, {"total": f"sum(gex) {over}"}, {"before": f"lag(total) {over}", "below": f"lag(strike) {over}"})
    at = "case when total = 0 then strike when before * total < 0 then below + (strike - below) * (-before) / (total - before) end"
    crossed = staged(rows, {"crossing": at}, {"k": f"sum(case when crossing is not null then 1 else 0 end) {over}"})
    return f"(select symbol, ts, spot, min(case when k = 1 then crossing end) as zero_gamma from {crossed} c group by symbol, ts, spot)"


def gamma_flip(source: str) -> str:
    """First strike whose net exposure has another sign than the one below."""
    e = exposure_by_strike(source)
    over = "over (partition by symbol, ts order by strike)"
    return f"(select symbol, ts, min(strike) as flip_strike from (select *, lag(gex) {over} as before from {e} e) r where before * gex < 0 group by symbol, ts)"


def nope(source: str) -> str:
    """Volume-weighted delta of calls less puts, over the underlying's volume."""
    g = greeks(source)
    return f"(select symbol, ts, sum(case when opt = 'C' then opt_volume * delta else 0 end) as call_flow, sum(case when opt = 'P' then opt_volume * delta else 0 end) as put_flow, (sum(case when opt = 'C' then opt_volume * delta else 0 end) - sum(case when opt = 'P' then opt_volume * delta else 0 end)) / nullif(max(stock_volume), 0) as nope from {g} g group by symbol, ts)"


def gamma_shape(d: Dialect, source: str) -> str:
    """Peak strike, share within 5 % of spot, balance above and below."""
    e = exposure_by_strike(source)
    return f"(select symbol, ts, spot, sum(case when abs(strike / spot - 1) <= 0.05 then abs(gex) else 0 end) / nullif(sum(abs(gex)), 0) as concentration, (sum(case when strike > spot then abs(gex) else 0 end) - sum(case when strike < spot then abs(gex) else 0 end)) / nullif(sum(abs(gex)), 0) as skew_side, {d.last('strike', 'round(abs(gex), 6)', 'strike')} as peak_strike from {e} e group by symbol, ts, spot)"


def vol_surface(source: str) -> str:
    """At-the-money and wing volatilities of each expiry by linear weights, skew and butterfly; slope over root time."""
    near = lambda m: f"sum(iv * greatest(0, 1 - abs(strike / spot - {m}) / 0.03)) / nullif(sum(greatest(0, 1 - abs(strike / spot - {m}) / 0.03)), 0)"
    per = f"(select symbol, ts, dte, {near('1.0')} as atm, {near('0.95')} as down, {near('1.05')} as up from {source} c group by symbol, ts, dte)"
    return staged(per, {"skew": "down - up", "butterfly": "(down + up) / 2 - atm", "term_slope": "covar_pop(atm, sqrt(dte)) over (partition by symbol, ts) / nullif(var_pop(sqrt(dte)) over (partition by symbol, ts), 0)"})


def chain_features(d: Dialect, source: str) -> str:
    """Put/call volume ratio, cost of the nearest straddle, the volatility it implies, and the term ratio."""
    priced = greeks(source)
    dist = f"(select *, row_number() over (partition by symbol, ts, dte, opt order by abs(strike - spot), strike) as k from {priced} g)"
    front = lambda n: f"sum(case when k = 1 and dte = {n} then price end)"
    return f"(select symbol, ts, cast(sum(case when opt = 'P' then opt_volume else 0 end) as double) / nullif(sum(case when opt = 'C' then opt_volume else 0 end), 0) as put_call, {front(30)} as straddle, {front(30)} / nullif(0.8 * max(spot) * sqrt(30 / cast(365 as double)), 0) as implied, {front(60)} / nullif({front(30)}, 0) as term_ratio from {dist} q group by symbol, ts)"


def wall_table(source: str, top: int = 3) -> str:
    """The strongest strikes of each day's calls and puts, with strength to 100 and distance from spot."""
    e = exposure_by_strike(source)
    long = f"(select symbol, ts, spot, strike, 'call' as kind, call_gex as exposure from {e} e union all select symbol, ts, spot, strike, 'put' as kind, put_gex as exposure from {e} f)"
    ranked = staged(long, {"strength": "least(100, 100 * exposure / nullif(max(exposure) over (partition by symbol, ts, kind), 0))", "rank_": "row_number() over (partition by symbol, ts, kind order by round(exposure, 6) desc, strike)"})
    return f"(select symbol, ts, kind, rank_, strike, strength, strike / spot - 1 as distance from {ranked} r where rank_ <= {top})"


#: How far out of the money the contract of a delta bucket lies; fewest days of a structure's statistics.
DELTA_BUCKETS = {"ATM": 0.0, "25D": 0.03, "10D": 0.06, "5D": 0.10}
LEAST_DAYS = 20


def structure_returns(d: Dialect, source: str) -> str:
    """Next day's return of calls, puts and both of each delta bucket and expiry: at the money a straddle, else a strangle.

    A bucket stands for a distance from spot; its contract is the one nearest in strike.  The exit is priced on the next day
    of the symbol within five days.
    """
    days = f"(select symbol, ts, spot, lead(ts) over (partition by symbol order by ts) as next_ts, lead(spot) over (partition by symbol order by ts) as next_spot from (select distinct symbol, ts, spot from {source} c) q)"
    away = ", ".join(f"cast({m} as double)" for m in DELTA_BUCKETS.values())
    every = f"explode(array({away}))" if d.spark else f"unnest([{away}])"
    near = f"(select symbol, ts, spot, dte, opt, strike, iv, oi, opt_volume, stock_volume, m, row_number() over (partition by symbol, ts, dte, opt, m order by abs(strike / spot - case when opt = 'C' then 1 + m else 1 - m end), strike) as k from (select *, {every} as m from {source} c) q)"
    entry = f"(select n.symbol, n.ts, n.spot, n.dte, n.opt, n.strike, n.iv, n.oi, n.opt_volume, n.stock_volume, n.m, d.next_spot, {d.days('d.next_ts', 'n.ts')} as gap from {near} n join {days} d on n.symbol = d.symbol and n.ts = d.ts where n.k = 1 and d.next_ts is not null)"
    a = f"(select symbol, ts, dte, opt, m, strike, spot, iv, gap, next_spot, price as entry_price from {greeks(entry)} g where gap <= 5)"
    b = f"(select symbol, ts, dte0 as dte, opt, m, price as exit_price from {greeks(f'(select symbol, ts, dte as dte0, greatest(dte - gap, 0) as dte, opt, m, strike, next_spot as spot, iv from {a} a0)')} g)"
    legs = f"(select a.symbol, a.ts, a.dte, a.opt, a.m, a.entry_price, b.exit_price from {a} a join {b} b on a.symbol = b.symbol and a.ts = b.ts and a.dte = b.dte and a.opt = b.opt and a.m = b.m)"
    bucket = "case " + " ".join(f"when m = {m} then '{n}'" for n, m in DELTA_BUCKETS.items()) + " end"
    single = f"(select symbol, ts, dte, concat(case when opt = 'C' then 'call_' else 'put_' end, {bucket}) as structure, exit_price / nullif(entry_price, 0) - 1 as r from {legs} l)"
    both = f"(select symbol, ts, dte, case when m = 0 then 'straddle' else concat('strangle_', {bucket}) end as structure, sum(exit_price) / nullif(sum(entry_price), 0) - 1 as r from {legs} l group by symbol, ts, dte, m)"
    return f"(select * from {single} s union all select * from {both} t)"


def surface_stats(source: str, d: Dialect = SPARK) -> str:
    """Statistics and rank of each structure and expiry, of the mean over symbols on every day.

    Yearly return and volatility, Sharpe, win rate, drawdown of the wealth that is put in anew each day, skewness and excess
    kurtosis (corrected for few days).  Structures of fewer than twenty days have none.  source: structure, dte, ts, r.
    """
    daily = f"(select structure, dte, ts, {d.mean('r')} as r from {source} s where r is not null group by structure, dte, ts)"
    by = "partition by structure, dte order by ts rows between unbounded preceding and current row"
    rows = staged(daily, {"lr": "ln(greatest(1 + r, 1e-9))", "centre": "avg(r) over (partition by structure, dte)"}, {"wealth": f"sum(lr) over ({by})"}, {"peak": f"max(wealth) over ({by})"})
    power = lambda k: " * ".join(["(r - centre)"] * k)
    sums = f"(select structure, dte, count(*) as n, avg(r) as mean, exp(sum(lr)) - 1 as total_return, exp(sum(lr) * 252.0 / count(*)) - 1 as ann_return, stddev_samp(r) * sqrt(252.0) as ann_vol, avg(case when r > 0 then cast(1 as double) else 0 end) as win_rate, min(exp(wealth - peak) - 1) as max_drawdown, avg({power(2)}) as m2, avg({power(3)}) as m3, avg({power(4)}) as m4 from {rows} x group by structure, dte having count(*) >= {LEAST_DAYS})"
    return staged(
        sums,
        {
            "sharpe": "ann_return / nullif(ann_vol, 0)",
            "skewness": "sqrt(cast(n as double) * (n - 1)) / (n - 2) * m3 / nullif(power(m2, 1.5), 0)",
            "kurtosis": "(n - 1) / (cast(n - 2 as double) * (n - 3)) * ((n + 1) * m4 / nullif(m2 * m2, 0) - 3 * (n - 1))",
        },
        {"rank_": "row_number() over (order by round(sharpe, 6) desc, structure, dte)"},
    )
