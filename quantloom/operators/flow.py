"""Order flow and inventory over bars or ticks: symbol, ts, open, high, low, close, volume (or price, size)."""

from __future__ import annotations

from ..frames import Series, staged

#: Coefficients of the rational approximation of the normal distribution function (Abramowitz and Stegun 26.2.17); fixed values.
_CDF = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_pdf(x: str) -> str:
    return f"exp(-0.5 * ({x}) * ({x})) * cast(0.3989422804014327 as double)"


def normal_cdf(x: str) -> str:
    """Normal distribution function to about 1e-7, as an expression."""
    p, *b = _CDF
    t = f"(1 / (1 + cast({p} as double) * abs({x})))"
    poly = " + ".join(f"cast({c} as double) * power({t}, {k})" for k, c in enumerate(b, 1))
    upper = f"({normal_pdf(x)} * ({poly}))"
    return f"case when ({x}) >= 0 then 1 - {upper} else {upper} end"


def tick_sign(s: Series, source: str, price: str = "price") -> str:
    """Sign of the price change; a tie carries the last sign, the first row is 0.  Rows that have one keep it."""
    if " as tick_sign" in source:
        return source
    return staged(source, {"step": f"sign({price} - {s.lag(price)})"}, {"tick_sign": f"coalesce({s.d.last_seen('case when step <> 0 then step end')} {s.U}, 0)"})


def bulk_volume(s: Series, source: str) -> str:
    """Buying share of volume by the normal distribution of the last return over its past deviation, one row later."""
    return staged(
        source,
        {"lr": f"ln(greatest(close, 1e-10) / greatest({s.lag('close')}, 1e-10))"},
        {"spread": f"greatest(stddev_pop(lr) {s.U}, 1e-10)", "seen": f"count(*) {s.U}"},
        {"z": "lr / spread"},
        {"share": normal_cdf("z")},
        {"buy_share": f"case when seen <= 2 then 0.5 else coalesce({s.lag('share')}, 0.5) end"},
        {"buy_volume": "volume * buy_share", "sell_volume": "volume * (1 - buy_share)"},
    )


def vpin_buckets(s: Series, source: str, size: float, n: int = 50) -> str:
    """Equal-volume buckets of bulk-classified bars and their mean imbalance over n buckets, stamped at the bucket's end.

    A bar belongs to the bucket in which its cumulative volume ends.
    """
    bars = staged(bulk_volume(s, source), {"cumulative": f"sum(volume) {s.U}"}, {"bucket": f"cast(floor(cumulative / {size}) as bigint)"})
    keys = ", ".join(s.keys)
    sums = f"(select {keys}, bucket, max({s.order[0]}) as ts, sum(buy_volume) as buy, sum(sell_volume) as sell, sum(volume) as volume from {bars} b group by {keys}, bucket)"
    over = Series(s.d, s.keys, ("bucket",))
    return staged(sums, {"imbalance": "abs(buy - sell) / volume"}, {"vpin": over.roll("avg", "imbalance", n, least=1)})


def price_impact(s: Series, source: str, n: int = 100, least: int = 50) -> str:
    """Regression of returns on signed root volume over the rows before: slope, fit and t."""
    return staged(
        source,
        {"r": f"close / {s.lag('close')} - 1", "signed": f"sign(close - {s.lag('close')}) * sqrt(volume)"},
        {"n": f"count(r) {s.P(n)}", "cxy": f"covar_pop(r, signed) {s.P(n)}", "vx": f"var_pop(signed) {s.P(n)}", "vy": f"var_pop(r) {s.P(n)}"},
        {"impact": f"case when n >= {least} then cxy / nullif(vx, 0) end", "fit": f"case when n >= {least} then cxy * cxy / nullif(vx * vy, 0) end"},
        {"impact_t": "case when fit < 1 then sign(impact) * sqrt(fit * (n - 2) / (1 - fit)) end"},
    )


def impact_ratio(s: Series, source: str, n: int = 50) -> str:
    """Deviation of returns over that of signed volume."""
    return staged(source, {"r": f"close / {s.lag('close')} - 1", "sv": f"sign(close - {s.lag('close')}) * volume"}, {"impact_ratio": f"{s.roll('stddev_pop', 'r', n)} / greatest({s.roll('stddev_pop', 'sv', n)}, 1e-10)"})


def order_flow_imbalance(s: Series, source: str) -> str:
    """Change of the best quotes' sizes: bid, ask, bid_size, ask_size."""
    return staged(
        source,
        {"pb": s.lag("bid"), "pa": s.lag("ask"), "pbs": s.lag("bid_size"), "pas": s.lag("ask_size")},
        {"bid_flow": "case when pb is null then 0 when bid > pb then bid_size when bid = pb then bid_size - pbs else -pbs end", "ask_flow": "case when pa is null then 0 when ask < pa then ask_size when ask = pa then ask_size - pas else -pas end"},
        {"ofi": "bid_flow - ask_flow"},
    )


def ofi_features(s: Series, source: str, n: int = 20) -> str:
    """Imbalance against price: regression, divergence, and a running sum by day."""
    day = Series(s.d, (*s.keys, "day"), s.order)
    return staged(
        order_flow_imbalance(s, source),
        {"dp": f"(bid + ask) / 2 - {s.lag('(bid + ask) / 2')}", "day": "cast(ts as date)", "ofi_z": f"(ofi - {s.roll('avg', 'ofi', n, past=True)}) / greatest({s.roll('stddev_pop', 'ofi', n, past=True)}, 1e-10)"},
        {"ofi_slope": f"case when count(dp) {s.P(n)} >= {n} then covar_pop(dp, ofi) {s.P(n)} / nullif(var_pop(ofi) {s.P(n)}, 0) end", "divergence": "case when ofi_z > 1 and dp < 0 then -1 when ofi_z < -1 and dp > 0 then 1 else 0 end", "ofi_day": f"sum(ofi) {day.U}"},
    )


def order_imbalance(s: Series, source: str, n: int = 50) -> str:
    """Signed, relative and logarithmic imbalance of buying and selling volume, and over a window."""
    return staged(bulk_volume(s, source), {"signed_imbalance": "buy_volume - sell_volume", "ratio_imbalance": "(buy_volume - sell_volume) / greatest(volume, 1e-10)", "log_imbalance": "ln(greatest(buy_volume, 1e-10) / greatest(sell_volume, 1e-10))"}, {"rolling_imbalance": f"{s.roll('sum', 'signed_imbalance', n)} / greatest({s.roll('sum', 'volume', n)}, 1e-10)"})


def large_blocks(s: Series, source: str, n: int = 100, share: float = 0.995) -> str:
    """Trades at or above a high percentile of size, the last one's direction, and its z-score."""
    return staged(
        tick_sign(s, source),
        {"cut": f"{s.d.quantile('size', share)} {s.R(n)}", "z_size": f"(size - avg(size) {s.R(n)}) / greatest(stddev_pop(size) {s.R(n)}, 1e-10)"},
        {"block": "case when size >= cut then 1 else 0 end"},
        {"block_direction": f"coalesce({s.d.last_seen('case when block = 1 then tick_sign end')} {s.R(n)}, 0)", "block_z": f"{s.d.last_seen('case when block = 1 then z_size end')} {s.R(n)}"},
    )


def spread_iceberg(s: Series, source: str, n: int = 20, m: int = 5) -> str:
    """Balance of signed volume over a few trades, and the share of the most repeated size with its price cluster."""
    d = s.d
    sizes = f"{d.collect('size')} {s.R(n)}"
    return staged(
        tick_sign(s, source),
        {"balance": f"1 - abs(sum(tick_sign * size) {s.R(m)}) / greatest(sum(size) {s.R(m)}, 1e-10)", "same_size": f"cast({d.size(d.filter(sizes, 'v', 'v = size'))} as double) / count(*) {s.R(n)}", "price_spread": f"stddev_pop(price) {s.R(n)} / greatest(avg(price) {s.R(n)}, 1e-10)"},
        {"iceberg": "case when same_size >= 0.3 and price_spread <= 0.5 then same_size * (1 - price_spread) else 0 end"},
    )


def sweeps(s: Series, source: str, n: int = 20, run: int = 3) -> str:
    """Longest run of trades in one direction in the window, and a flag from `run` on."""
    return staged(
        tick_sign(s, source),
        {"turn": f"case when tick_sign is distinct from {s.lag('tick_sign')} then 1 else 0 end"},
        {"island": f"sum(turn) {s.U}"},
        {"run_length": f"row_number() over (partition by {', '.join(s.keys)}, island order by {', '.join(s.order)})"},
        {"longest_run": f"max(run_length) {s.R(n)}"},
        {"sweep": f"case when longest_run >= {run} and tick_sign <> 0 then tick_sign else 0 end"},
    )


def smart_money(s: Series, source: str, n: int = 100) -> str:
    """Five signals of large traders, weighted and capped to 0 .. 1, a row late.

    Blocks count by their z-score up to 5, a negative correlation of signed size and price change as a hedge, balanced
    buying and selling as a spread, repeated sizes as an iceberg, runs in one direction as a sweep.
    """
    rows = sweeps(s, spread_iceberg(s, large_blocks(s, source, n)))
    return staged(
        rows,
        {"signed_size": "tick_sign * size", "move": f"price - {s.lag('price')}"},
        {"hedge": f"case when count(move) {s.R(20)} = 20 then coalesce(covar_pop(signed_size, move) {s.R(20)} / nullif(stddev_pop(signed_size) {s.R(20)} * stddev_pop(move) {s.R(20)}, 0), 0) else 0 end"},
        {"index_now": "greatest(0, least(1, case when block_z is not null then 0.25 * least(1, abs(block_z) / 5) else 0 end + case when hedge < -0.3 then 0.2 * least(1, abs(hedge)) else 0 end + case when balance > 0.3 then 0.15 * balance else 0 end + case when iceberg > 0.3 then 0.2 * iceberg else 0 end + case when sweep <> 0 then 0.2 else 0 end))"},
        {"smart_money_index": s.lag("index_now")},
    )


def cumulative_delta(s: Series, source: str) -> str:
    """Running buying less selling volume, and by month."""
    month = Series(s.d, (*s.keys, "month"), s.order)
    return staged(bulk_volume(s, source), {"delta": "buy_volume - sell_volume", "month": "date_trunc('month', ts)"}, {"cumulative_delta": f"sum(delta) {s.U}", "month_delta": f"sum(delta) {month.U}"})


def inventory(s: Series, source: str, n: int = 100, gamma: float = 0.1, horizon: float = 1.0) -> str:
    """Inventory z-score on the rows before, the reversion signal, pressure, and reservation quotes."""
    return staged(
        cumulative_delta(s, source),
        {"inventory": "-cumulative_delta", "step_return": f"ln(close / {s.lag('close')})"},
        {"inv_mean": s.roll("avg", "inventory", n, past=True), "inv_dev": s.roll("stddev_pop", "inventory", n, past=True), "sigma": s.roll("stddev_samp", "step_return", 20), "pressure": f"{s.roll('sum', '-delta', 50)} / greatest({s.roll('sum', 'volume', 50)}, 1e-10)"},
        {"inventory_z": "(inventory - inv_mean) / greatest(inv_dev, 1e-10)"},
        {"reversion": "case when inventory_z > 2 then -1 when inventory_z < -2 then 1 when inventory_z is not null then 0 end", "reservation": f"close * (1 - {gamma} * inventory_z * sigma * sigma * {horizon})", "half_spread": f"close * ({gamma} * sigma * sigma * {horizon} / 2 + 0.0005)"},
        {"best_bid": "reservation - half_spread", "best_ask": "reservation + half_spread"},
    )


def hedge_footprint(s: Series, source: str, n: int = 20) -> str:
    """Correlation of two flows, option_flow and stock_flow, over the last rows."""
    return staged(source, {"hedge_corr": f"case when count(option_flow) {s.R(n)} = {n} then covar_pop(option_flow, stock_flow) {s.R(n)} / nullif(stddev_pop(option_flow) {s.R(n)} * stddev_pop(stock_flow) {s.R(n)}, 0) end"})
