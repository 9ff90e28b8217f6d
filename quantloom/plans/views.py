"""Market-shaped views of the given tables, as SQL for both engines."""

from __future__ import annotations

from ..frames import Dialect

TIE = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


def ticks(d: Dialect) -> str:
    """Trades: a line item is a tick of its part's type, priced to the cent."""
    return "(select p_type as symbol, l_shipdate as ts, floor(l_extendedprice / l_quantity * 100) / cast(100 as double) as price, l_quantity as size, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_suppkey from {lineitem} join {part} on l_partkey = p_partkey where l_quantity > 0)"


def bars(d: Dialect) -> str:
    """Daily bars of every symbol."""
    return f"(select symbol, ts, {d.first('price', *TIE)} as open, max(price) as high, min(price) as low, {d.last('price', *TIE)} as close, sum(size) as volume, sum(l_extendedprice) / sum(size) as vwap, count(*) as trades from {ticks(d)} group by symbol, ts)"


def events_ticks(d: Dialect) -> str:
    return f"(select event_type as symbol, ts, value as price, cast({d.json('props', 'k')} as double) as size, event_id, user_id from {{events}})"


def quotes(d: Dialect) -> str:
    return "(select user_id, ts, 0.99 * value as bid, 1.01 * value as ask, event_id from {events} where event_type = 'view')"


def buys(d: Dialect) -> str:
    return "(select user_id, ts, value as price, event_id from {events} where event_type = 'purchase')"


def returns(d: Dialect) -> str:
    """Daily returns of every symbol."""
    return f"(select symbol, ts, close, volume, close / lag(close, 1) over (partition by symbol order by ts) - 1 as r from {bars(d)} b)"


def chain(d: Dialect) -> str:
    """A deterministic option chain around each bar's close, priced by a closed form."""
    offsets = d.explode(d.series("-2", "2"), "o")
    dte = "explode(array(7, 30, 60))" if d.spark else "unnest([7, 30, 60])"
    right = "explode(array('C', 'P'))" if d.spark else "unnest(['C', 'P'])"
    base = f"(select symbol, ts, close as spot, volume, {offsets} from {bars(d)} b)"
    base = f"(select *, {dte} as dte from {base} b1)"
    base = f"(select *, {right} as opt from {base} b2)"
    return f"""(select symbol, ts, spot, volume as stock_volume, dte, opt, floor(spot * (100 + 3 * o)) / cast(100 as double) as strike, cast(1800 + 200 * abs(o) - 50 * o + 4 * dte as double) / 10000 as iv,
      100 + 37 * ((o + 4) * 3 + dte + case when opt = 'C' then 1 else 0 end) % 211 as oi, 10 + (o + 5) * 7 + dte as opt_volume from {base} b3)"""


def trades(d: Dialect) -> str:
    return "(select o_orderpriority as strategy, o_orderstatus as regime, o_orderdate as entry, o_totalprice - 250000 as pnl, o_orderkey as trade_id, o_custkey as account from {orders})"


def paths(d: Dialect) -> str:
    """Marked-to-market paths: the line items of an order are its days."""
    order = "l_linenumber, l_shipdate, l_extendedprice, l_quantity, l_partkey"
    step = "floor(l_extendedprice * (l_discount - 0.05)) / cast(100 as double)"
    return f"(select l_orderkey as trade_id, row_number() over (partition by l_orderkey order by {order}) as day, l_shipdate as date, l_returnflag as profile, round(sum({step}) over (partition by l_orderkey order by {order} rows between unbounded preceding and current row), 4) as pnl, l_extendedprice / l_quantity as spot from {{lineitem}})"
