"""Queries of sources and sinks: files are written from the given tables to the shared folder and scanned back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import DUCK, SPARK, Dialect, Series, output
from ..sources import files
from ..sources.shared import new_path
from . import views
from .registry import native, query, relation

DAY = ("symbol", "ts")


def contracts(d: Dialect) -> str:
    """A traded contract of each tick: its code, price, size and time in nanoseconds."""
    right = "case when l_orderkey % 2 = 0 then 'C' else 'P' end"
    strike = "cast(floor(price / 250) * 250000 as bigint)"
    ticks = views.ticks(d)
    if d.spark:
        code = f"concat('O:', substring(symbol, 1, 3), date_format(date_add(date_trunc('month', ts), 45), 'yyMMdd'), {right}, lpad(cast({strike} as string), 8, '0'))"
        ns = "unix_micros(cast(ts as timestamp)) * 1000"
    else:
        code = f"concat('O:', substring(symbol, 1, 3), strftime(date_trunc('month', ts) + to_days(45), '%y%m%d'), {right}, lpad(cast({strike} as varchar), 8, '0'))"
        ns = "epoch_us(ts) * 1000"
    return f"(select {code} as ticker, cast(ts as date) as day, price, size, {ns} + (l_orderkey % 390) * 60000000000 as window_start, l_orderkey, l_linenumber, l_extendedprice, l_quantity from {ticks} t)"


def option_days(d: Dialect) -> str:
    """Rows of the files, one for each month of the ticks: a contract's open, high, low, close, volume and transactions."""
    return f"(select ticker, cast(date_trunc('month', day) as date) as day, cast(sum(size) as bigint) as volume, {d.first('price', *views.TIE)} as open, {d.last('price', *views.TIE)} as close, max(price) as high, min(price) as low, min(window_start) as window_start, count(*) as transactions from {contracts(d)} c group by ticker, cast(date_trunc('month', day) as date))"


def scan_option_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option days written as gzip CSV, a folder a year with the day in each file's name, and read back by declared schema."""
    path = new_path(spark, "option-days")
    rows = relation(spark, sf_dir, option_days(SPARK))
    columns = ["ticker", "volume", "open", "close", "high", "low", "window_start", "transactions"]
    rows.select(F.year("day").alias("year"), F.col("day").cast("string").alias("day_"), *columns).repartition("year").write.partitionBy("year", "day_").option("header", True).option("compression", "gzip").csv(path)
    back = files.scan_option_days(spark, f"{path}/*/*", date_column="day_")
    return back.select("ticker", F.col("date").cast("string").alias("day"), "root", "opt", F.round("strike", 3).alias("strike"), "dte", "open", "close", "volume", "transactions")


PARTS = "substring(ticker, 3, 3) as root, substring(ticker, 12, 1) as opt, round(cast(substring(ticker, 13, 8) as double) / 1000, 3) as strike"
native("s02_option_days", scan_option_days, f"select ticker, cast(day as varchar) as day, {PARTS}, date_diff('day', day, cast(strptime(substring(ticker, 6, 6), '%y%m%d') as date)) as dte, open, close, volume, transactions from {option_days(DUCK)} o where regexp_matches(ticker, '^O:([A-Z.]+[0-9]?)([0-9]{{6}})([CP])([0-9]{{8}})$')")


def written_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, f"(select symbol, ts, open, high, low, close, cast(volume as double) as volume from {views.bars(SPARK)} b)")


def scan_futures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as one file name for each symbol and timeframe, under other column names, and scanned by symbol."""
    path = new_path(spark, "futures")
    bars = written_bars(spark, sf_dir)
    out = None
    for symbol in ("ECONOMY", "PROMO"):
        one = bars.filter(F.col("symbol") == symbol).withColumnsRenamed({"ts": "ts_event", "open": "O", "close": "C", "volume": "Vol"}).drop("symbol")
        one.write.parquet(f"{path}/{symbol}_ohlcv_1d_all.parquet")
        back = files.scan_futures(spark, path, symbol, "1d", ("symbol", "ts", "open", "close", "volume"))
        out = back if out is None else out.unionByName(back)
    return out


native("s03_scan_futures", scan_futures, f"select symbol, ts, open, close, cast(volume as double) as volume from {views.bars(DUCK)} b where symbol in ('ECONOMY', 'PROMO')")
query("s04_scan_many", lambda d: f"select symbol, ts, open, close from {views.bars(d)} b where symbol in ('ECONOMY', 'LARGE', 'SMALL') and ts >= timestamp '1996-01-01' and ts < timestamp '1999-01-01'")


def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars in a store of a folder a symbol and day, read back with the partition columns."""
    path = new_path(spark, "partitioned")
    bars = written_bars(spark, sf_dir).withColumn("month", F.date_trunc("month", "ts"))
    files.write_partitioned(bars, path, day="month")
    return spark.read.schema("ts timestamp, close double, volume double, symbol string, date date").parquet(path).groupBy("symbol", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("closes"), F.sum("volume").alias("volume"))


native("s06_write_partitioned", partitioned, f"select symbol, cast(cast(date_trunc('month', ts) as date) as varchar) as date, count(*) as n, round(sum(close), 4) as closes, cast(sum(volume) as double) as volume from {views.bars(DUCK)} b group by symbol, cast(date_trunc('month', ts) as date)")


def minute_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars of one kind of event, added to a store that has the first days: existing days are left out."""
    path = new_path(spark, "minutes")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'click'").select(F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    order = F.struct("ts", "event_id")
    minutes = rows.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n")).withColumns({"symbol": F.lit("click"), "date": F.to_date("minute")})
    minutes.filter("date < date '2024-01-10'").write.partitionBy("symbol", "date").parquet(path)
    there = spark.read.schema("symbol string, date date").parquet(path)
    minutes.join(files.missing_days(minutes.select("symbol", "date").distinct(), there), ["symbol", "date"]).write.mode("append").partitionBy("symbol", "date").parquet(path)
    return spark.read.schema("minute timestamp, open double, high double, low double, close double, n long, symbol string, date date").parquet(path).select(F.col("minute").cast("timestamp_ntz").alias("minute"), "open", "high", "low", "close", "n")


native("s07_minute_store", minute_store, "select date_trunc('minute', ts) as minute, first(value order by ts, event_id) as open, max(value) as high, min(value) as low, last(value order by ts, event_id) as close, count(*) as n from events where event_type = 'click' group by date_trunc('minute', ts)")


def lake_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad-hoc SQL over views of the lake."""
    return files.lake_sql(spark, {"lake_bars": written_bars(spark, sf_dir)}, "select symbol, year(ts) as year_, count(*) as n, max(close) as top from lake_bars where volume > 50 group by symbol, year(ts)")


native("s09_lake_sql", lake_sql, f"select symbol, year(ts) as year_, count(*) as n, max(close) as top from {views.bars(DUCK)} b where volume > 50 group by symbol, year(ts)")


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series of the orders, each filled forward over every day of the calendar."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.col("o_orderdate").cast("date").alias("date")
    long = orders.filter("o_orderstatus = 'F'").groupBy(day).agg(F.round(F.avg("o_totalprice"), 7).alias("value")).withColumn("series_id", F.lit("filled"))
    long = long.unionByName(orders.filter("o_orderstatus = 'P'").groupBy(day).agg(F.round(F.avg("o_totalprice"), 7).alias("value")).withColumn("series_id", F.lit("partial")))
    ends = orders.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b")).first()
    return files.load_macro(long, str(ends.a), str(ends.b), ["filled", "partial"]).withColumn("date", F.col("date").cast("string"))


_SERIES = "(select cast(o_orderdate as date) as date, round(avg(o_totalprice), 7) as value from orders where o_orderstatus = '{}' group by cast(o_orderdate as date))"
native("s10_load_macro", macro_series, f"select cast(date as varchar) as date, last_value(filled ignore nulls) over (order by date rows between unbounded preceding and current row) as filled, last_value(partial ignore nulls) over (order by date rows between unbounded preceding and current row) as partial from (select d.date, f.value as filled, p.value as partial from (select cast(unnest(generate_series((select min(o_orderdate) from orders), (select max(o_orderdate) from orders), interval 1 day)) as date) as date) d left join {_SERIES.format('F')} f on d.date = f.date left join {_SERIES.format('P')} p on d.date = p.date) x")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event calendar written as CSV, one event for each day's largest order, and read back by declared schema."""
    path = new_path(spark, "calendar")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    top = orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.max("o_totalprice").alias("value"), F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("name"))
    top.select(F.col("day").cast("timestamp").alias("timestamp"), F.col("name").alias("event_name"), F.when(F.col("value") > 300000, "HIGH").when(F.col("value") > 200000, "MEDIUM").otherwise("LOW").alias("impact_level")).write.option("header", True).csv(path)
    return files.load_calendar(spark, path).select(F.col("ts").cast("date").cast("string").alias("day"), "event_name", "impact")


native("s11_load_calendar", calendar, "select cast(cast(o_orderdate as date) as varchar) as day, last(o_orderpriority order by o_totalprice, o_orderkey) as event_name, case when max(o_totalprice) > 300000 then 'HIGH' when max(o_totalprice) > 200000 then 'MEDIUM' else 'LOW' end as impact from orders group by cast(o_orderdate as date)")


def features_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written to a folder a symbol and read back."""
    path = new_path(spark, "features")
    files.write_features(relation(spark, sf_dir, f"(select symbol, ts, round(r, 9) as r, volume from {views.returns(SPARK)} r where r is not null)"), path)
    return spark.read.schema("ts timestamp, r double, volume double, symbol string").parquet(path).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("r"), 5).alias("total"), F.countDistinct("ts").alias("days"))


native("s12_write_features", features_written, f"select symbol, count(*) as n, round(sum(r), 5) as total, count(distinct ts) as days from (select symbol, ts, round(r, 9) as r from {views.returns(DUCK)} r where r is not null) x group by symbol")


def trade_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades written as nested JSON records, and read back as a labelled row a day."""
    path = new_path(spark, "trades")
    rows = relation(spark, sf_dir, views.paths(SPARK))
    one = F.struct(F.col("day").cast("int").alias("day"), "pnl", F.round("spot", 6).alias("spot"))
    nested = rows.groupBy("trade_id").agg(F.sort_array(F.collect_list(one)).alias("path")).withColumns({"entry": F.struct(F.element_at("path", 1)["spot"].alias("spot")), "exit": F.struct(F.element_at("path", -1)["pnl"].alias("final_pnl"), F.array_max(F.col("path.pnl")).alias("peak"))})
    nested.write.json(path)
    return files.read_trade_paths(spark, path).select("trade_id", "day", (F.round("pnl", 4) + F.lit(0.0)).alias("pnl"), (F.round("peak_so_far", 4) + F.lit(0.0)).alias("peak_so_far"), "label")


_PEAK = "max(pnl) over (partition by trade_id order by day rows between unbounded preceding and current row)"
native("s13_trade_paths", trade_paths, f"select trade_id, cast(day as int) as day, round(pnl, 4) + 0.0::double as pnl, round({_PEAK}, 4) + 0.0::double as peak_so_far, case when max(pnl) over (partition by trade_id) <= 20 then 'peakless' when pnl >= 0.8 * max(pnl) over (partition by trade_id) then 'near_peak' else 'off_peak' end as label from {views.paths(DUCK)} p")
query("s15_contract_minutes", lambda d: f"select ticker, minute_, min(price) as low, max(price) as high, sum(size) as volume from (select c.ticker, c.window_start // 60000000000 as minute_, c.price, c.size from {contracts(d)} c join (select ticker from {contracts(d)} w group by ticker having count(*) >= 2) k on c.ticker = k.ticker) x group by ticker, minute_".replace("//", "div" if d.spark else "//"))
query("j02_cross_asset_features", lambda d: output(f"(select a.symbol, a.ts, a.r, m.mean_r, m.spread_r, a.r - m.mean_r as excess from {views.returns(d)} a left join (select ts, avg(r) as mean_r, max(r) - min(r) as spread_r from {views.returns(d)} x where r is not null group by ts) m on a.ts = m.ts where a.r is not null)", DAY, ["mean_r", "spread_r", "excess"], [], 6))
query("c09_normalized_columns", lambda d: f"select symbol, ts, open, close, coalesce(volume, 0) as volume from (select p_type as symbol, l_shipdate as ts, l_extendedprice as open, l_extendedprice * (1 - l_discount) as close, nullif(l_quantity, 1) as volume from {{lineitem}} join {{part}} on l_partkey = p_partkey) x where symbol is not null and ts is not null and open is not null and close is not null")
query("z05_concatenated", lambda d: " union all ".join(f"select '{s}' as source, symbol, ts, close from {views.bars(d)} b{k} where symbol = '{s}'" for k, s in enumerate(("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))))
