"""Streams over the events, run on what is there and held against the same windows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recursions as R
from ..sources.shared import new_path
from ..sources.store import KeyedTable
from ..streaming import carried
from ..streaming import streams as T
from .registry import native


def _ticks(spark: SparkSession, sf_dir: str, streaming: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    if streaming:
        # the file source takes a directory: the table's own, or the file's with a glob
        df = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if _is_file(spark, path) else "*.parquet").parquet(sf_dir if _is_file(spark, path) else path)
    else:
        df = spark.read.parquet(path)
    return df.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("size"), "event_id", *extra)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _drained(df: DataFrame, mode: str, end: Callable[[], None] | None = None) -> DataFrame:
    """The rows of a stream after it has read what is there; in complete mode, the last result.

    end: says that the feed has ended; the stream then goes on from its checkpoint and gives what waited for its watermark.
    """
    spark = df.sparkSession
    path = new_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    def run() -> None:
        with carried.state_store(spark):
            q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()

    run()
    if end is not None:
        end()
        run()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


K = "cast(json_extract_string(props, '$.k') as double)"
#: What the watermark has passed once the stream has read all events.
PASSED = "(select max(ts) - interval '10 minutes' from events)"


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _bars_sql(minutes: int) -> str:
    bucket = f"time_bucket(interval '{minutes} minutes', ts)"
    return f"(select event_type as symbol, {bucket} as ts, first(value order by ts, event_id) as open, max(value) as high, min(value) as low, last(value order by ts, event_id) as close, sum({K}) as volume, round(sum(value * {K}) / sum({K}), 7) as vwap, count(*) as trade_count from events group by event_type, {bucket} having {bucket} + interval '{minutes} minutes' <= {PASSED})"


native("t01_stream_bars", lambda s, d: _ntz(_drained(T.stream_bars(_ticks(s, d), "1 hour"), "append"), "ts").withColumn("vwap", F.round("vwap", 7)), f"select * from {_bars_sql(60)} b")
native(
    "t02_multi_symbol",
    lambda s, d: _drained(T.stream_bars(_ticks(s, d), "30 minutes"), "append").groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("trade_count").alias("ticks"), F.max("high").alias("top")),
    f"select symbol, count(*) as bars, cast(sum(trade_count) as bigint) as ticks, max(high) as top from {_bars_sql(30)} b group by symbol",
)
native(
    "t03_rolling_state",
    lambda s, d: _ntz(_drained(T.rolling_state(_ticks(s, d).withColumnRenamed("price", "close")), "append"), "ts").select("symbol", "ts", "event_id", F.round("mean", 6).alias("mean"), F.col("ready").cast("int").alias("ready")),
    "select event_type as symbol, ts, event_id, round(avg(value) over w, 6) as mean, case when count(*) over w >= 5 then 1 else 0 end as ready from events window w as (partition by event_type order by ts, event_id rows between 19 preceding and current row)",
)


#: Rows whose time the watermark has passed once the stream has read all events.
BEFORE = "(select date_trunc('millisecond', max(ts)) - interval '10 minutes' from events)"


def warmed_up(spark: SparkSession, sf_dir: str, cut: str = "2024-01-15") -> DataFrame:
    """Means of the last twenty closes of every streamed row: the stream's state starts from the last rows of its history, and its end is marked."""
    rows = lambda streaming: _ticks(spark, sf_dir, streaming).select("symbol", "ts", "event_id", F.col("price").alias("close"))
    history = T.last_rows(rows(False).filter(F.col("ts") < F.lit(cut)), 20)
    live = rows(True).filter(F.col("ts") >= F.lit(cut))
    marks = carried.Marks(spark, new_path(spark, "marks"))
    found = carried.scan_stream(live, ["symbol"], ["ts", "event_id"], R.LastMean, "mean double, n double", history=history, marks=marks)
    return _ntz(_drained(found, "append", lambda: marks.end(rows(False))).select("symbol", "ts", "event_id", F.round("mean", 6).alias("mean"), F.col("n").cast("long").alias("n")), "ts")


native("t04_warm_up", warmed_up, "select * from (select event_type as symbol, ts, event_id, round(avg(value) over w, 6) as mean, count(*) over w as n from events window w as (partition by event_type order by ts, event_id rows between 19 preceding and current row)) x where ts >= timestamp '2024-01-15'")


def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sum of a symbol's last five signed sizes changes its side, from a stream that carries the last side of each symbol."""
    signed = _ticks(spark, sf_dir, extra=("user_id",)).select("symbol", "ts", "event_id", (F.col("size") * F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)).alias("signed"))
    found = _drained(carried.scan_stream(signed, ["symbol"], ["ts", "event_id"], R.Exposure, "exposure double, was double, side double").filter("was <> 0 and was <> side"), "append")
    return _ntz(found.select("symbol", "ts", "event_id", "exposure", F.col("side").cast("int").alias("side")), "ts")


native("t11_flip_stream", flips, f"select symbol, ts, event_id, exposure, side from (select *, lag(side) over (partition by symbol order by ts, event_id) as was from (select *, case when exposure >= 0 then 1 else -1 end as side from (select event_type as symbol, ts, event_id, sum(case when user_id % 2 = 0 then {K} else -{K} end) over (partition by event_type order by ts, event_id rows between 4 preceding and current row) as exposure from events) x) y) z where was <> side and ts < {BEFORE}")


def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of a change, run length and mean of each symbol's prices in hundreds, from a stream that carries the posterior."""
    rows = _ticks(spark, sf_dir).select("symbol", "ts", "event_id", (F.col("price") / 100).alias("x"))
    found = _drained(carried.scan_stream(rows, ["symbol"], ["ts", "event_id"], R.RunLengths, "change double, run_length double, mean double"), "append")
    return _ntz(found.select("symbol", "ts", "event_id", *(F.round(c, 6).alias(c) for c in ("change", "run_length", "mean"))), "ts")


native("g17_run_length_stream", posterior)


def fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a feed of messages, every fiftieth of them broken, parsed from a stream."""
    t = _ticks(spark, sf_dir)
    ms = (F.unix_millis("ts") % 86_400_000).alias("ms_of_day")
    message = F.to_json(F.struct("symbol", "price", "size", F.date_format("ts", "yyyyMMdd").cast("int").alias("date"), ms, F.col("event_id").alias("sequence")))
    raw = t.select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{oops"), message)).otherwise(message).alias("value"))
    return _ntz(_drained(T.parse_feed(raw), "append"), "ts")


native("t05_parse_feed", fed, f"select event_type as symbol, date_trunc('millisecond', ts) as ts, value as price, {K} as size, event_id from events where event_id % 50 <> 0 and value > 0 and {K} > 0")
native(
    "t06_drop_stale",
    lambda s, d: _ntz(_drained(T.drop_stale(_ticks(s, d).withColumn("received", F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 7).cast("int"))), "3 minutes", "received").select("symbol", "ts", "event_id", "price"), "append"), "ts"),
    "select event_type as symbol, ts, event_id, value as price from events where event_id % 7 <= 3",
)


def quoted(ticks: DataFrame) -> DataFrame:
    return ticks.withColumns({"bid": F.round(F.col("price") * 0.99, 6), "ask": F.round(F.col("price") * 1.01, 6)})


def last_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last quote of each symbol: what a batch changes is merged into a table that has a row for each symbol."""
    quotes = T.latest_quote(quoted(_ticks(spark, sf_dir)))
    table = KeyedTable(spark, new_path(spark, "quotes"), quotes.schema, ("symbol",), ("ts",), 4)
    table.follow(quotes, new_path(spark, "quotes-state"), "quotes").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "bid", "ask")


native("t07_latest_quote", last_quotes, "select event_type as symbol, max(ts) as ts, round(last(value order by ts, event_id) * 0.99, 6) as bid, round(last(value order by ts, event_id) * 1.01, 6) as ask from events group by event_type")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open position in each symbol, long or short by its count of events, entered at its mean price."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("event_type").alias("symbol")).agg(F.when(F.count("*") % 2 == 0, 10).otherwise(-10).alias("quantity"), F.round(F.avg("value"), 4).alias("entry"))


native(
    "t08_mark_positions",
    lambda s, d: _ntz(_drained(T.mark_positions(quoted(_ticks(s, d)), positions(s, d)).select("symbol", "ts", "event_id", "quantity", F.round("unrealised", 4).alias("unrealised")), "append"), "ts"),
    "select event_type as symbol, ts, event_id, quantity, round((case when quantity > 0 then round(value * 0.99, 6) else round(value * 1.01, 6) end - entry) * quantity, 4) as unrealised from events join (select event_type as symbol, case when count(*) % 2 = 0 then 10 else -10 end as quantity, round(avg(value), 4) as entry from events group by event_type) p on event_type = p.symbol",
)
def signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of the last three closes of every closed bar: a stream of ticks closes bars into a table, and a stream of that table carries the closes; its end is marked."""
    path = new_path(spark, "bars")
    bars = T.stream_bars(_ticks(spark, sf_dir), "1 hour").select("symbol", "ts", "close")
    T.append_bars(bars, path, new_path(spark, "bars-state")).awaitTermination()
    closed = spark.readStream.schema(bars.schema).parquet(path)
    marks = carried.Marks(spark, new_path(spark, "marks"))
    found = carried.scan_stream(closed, ["symbol"], ["ts"], R.Moves, "signal double", late="0 seconds", marks=marks)
    found = _drained(found, "append", lambda: marks.end(spark.read.schema(bars.schema).parquet(path), "0 seconds"))
    return _ntz(found.select("symbol", "ts", "close", F.col("signal").cast("int").alias("signal")), "ts")


native("t09_stream_signals", signalled, f"select symbol, ts, close, case when moved = 3 then 1 when moved = -3 then -1 else 0 end as signal from (select *, sum(step) over (partition by symbol order by ts rows between 2 preceding and current row) as moved from (select *, sign(close - lag(close) over (partition by symbol order by ts)) as step from {_bars_sql(60)} b) x) y")


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last view of its user in the hour before, by a join of two streams."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema

    def side(kind: str) -> DataFrame:
        file = _is_file(spark, path)
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if file else "*.parquet").parquet(sf_dir if file else path)
        rows = rows.filter(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")
        return quoted(rows)

    pairs = _drained(T.trade_quote(side("purchase").drop("bid", "ask"), side("view"), "1 hour"), "append")
    return _ntz(pairs.groupBy("symbol", "ts", "event_id", "price").agg(F.max("quote_ts").alias("quote_ts"), F.max_by("bid", F.struct("quote_ts", "bid")).alias("bid")), "ts", "quote_ts")


native("t10_trade_quote_asof", asof, "select cast(t.user_id as varchar) as symbol, t.ts, t.event_id, t.value as price, max(q.ts) as quote_ts, last(round(q.value * 0.99, 6) order by q.ts, q.value) as bid from events t join events q on t.user_id = q.user_id and q.ts <= t.ts and q.ts >= t.ts - interval '1 hour' where t.event_type = 'purchase' and q.event_type = 'view' group by t.user_id, t.ts, t.event_id, t.value")
native(
    "t12_sessions",
    lambda s, d: _drained(T.sessions(_ticks(s, d), "30 minutes"), "append").select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), "n", "volume"),
    f"select symbol, min(ts) as start, count(*) as n, sum(k) as volume from (select *, sum(case when was is null or ts >= was + interval '30 minutes' then 1 else 0 end) over (partition by symbol order by ts, event_id) as spell from (select event_type as symbol, ts, event_id, {K} as k, lag(ts) over (partition by event_type order by ts, event_id) as was from events) x) y group by symbol, spell having max(ts) + interval '30 minutes' <= {PASSED}",
)
native(
    "t12_sliding_bars",
    lambda s, d: _drained(T.sliding_bars(_ticks(s, d), "1 hour", "30 minutes"), "append").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("mean", 6).alias("mean"), "volume"),
    f"select symbol, ts, round(avg(value), 6) as mean, sum(k) as volume from (select event_type as symbol, value, {K} as k, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as ts from events) x where ts + interval '1 hour' <= {PASSED} group by symbol, ts",
)
native(
    "t12_dedup",
    lambda s, d: _ntz(_drained(T.deduplicated(_ticks(s, d).unionByName(_ticks(s, d))).select("symbol", "ts", "event_id", "price"), "append"), "ts"),
    "select event_type as symbol, ts, event_id, value as price from events",
)
