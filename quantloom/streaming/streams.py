"""Bars, latest quotes, marked positions, sessions and change points from streams of ticks.

Each function takes and returns a streaming or a batch DataFrame, so that a stream can be held against a batch.
Ticks have symbol, ts (timestamp), price, size and event_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRADE = "symbol string, price double, size double, date int, ms_of_day long, sequence long"


def parse_feed(raw: DataFrame, column: str = "value") -> DataFrame:
    """Trade messages as JSON: date as yyyymmdd and milliseconds of the day become a time; malformed rows are dropped."""
    m = raw.select(F.from_json(F.col(column).cast("string"), TRADE).alias("m")).select("m.*")
    day = F.try_to_timestamp(F.col("date").cast("string"), F.lit("yyyyMMdd"))
    out = m.withColumn("ts", F.timestamp_micros(F.unix_micros(day) + F.col("ms_of_day") * 1000))
    return out.filter("symbol is not null and price > 0 and size > 0 and ts is not null").select("symbol", "ts", "price", "size", F.col("sequence").alias("event_id"))


def stream_bars(ticks: DataFrame, interval: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars of every symbol, complete once the watermark passes them."""
    order = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", interval)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"), (F.sum(F.col("price") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0.0))).alias("vwap"), F.count("*").alias("trade_count"),
    )
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap", "trade_count")


def sliding_bars(ticks: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean price and volume of sliding windows."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, slide)).agg(F.avg("price").alias("mean"), F.sum("size").alias("volume")).select("symbol", F.col("window.start").alias("ts"), "mean", "volume")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Spells of activity that end after a gap."""
    return ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("size").alias("volume")).select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "volume")


def deduplicated(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if ticks.isStreaming else ticks.dropDuplicates(["event_id"])


def drop_stale(ticks: DataFrame, age: str, received: str | None = None) -> DataFrame:
    """Ticks no older than `age` when they were received: by a column, or by the clock."""
    at = F.col(received) if received else F.current_timestamp()
    return ticks.filter(F.col("ts") >= at - F.expr(f"interval {age}"))


def latest_quote(quotes: DataFrame) -> DataFrame:
    """The last quote of each symbol, for update or complete mode."""
    return quotes.groupBy("symbol").agg(F.max_by(F.struct("ts", "bid", "ask"), F.struct("ts", "event_id")).alias("q")).select("symbol", "q.*")


def mark_positions(quotes: DataFrame, positions: DataFrame) -> DataFrame:
    """Quotes joined to open positions (symbol, quantity, entry): the unrealised profit at the side that closes them."""
    side = F.when(F.col("quantity") > 0, F.col("bid")).otherwise(F.col("ask"))
    return quotes.join(positions, "symbol").withColumn("unrealised", (side - F.col("entry")) * F.col("quantity"))


def trade_quote(trades: DataFrame, quotes: DataFrame, within: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Pairs of a trade and each quote of its symbol at most `within` before it."""
    t = trades.withWatermark("ts", late).alias("t")
    q = quotes.withWatermark("ts", late).alias("q")
    on = (F.col("t.symbol") == F.col("q.symbol")) & (F.col("q.ts") <= F.col("t.ts")) & (F.col("q.ts") >= F.col("t.ts") - F.expr(f"interval {within}"))
    return t.join(q, on).select("t.symbol", "t.ts", "t.price", "t.event_id", F.col("q.ts").alias("quote_ts"), "q.bid", "q.ask")


def rolling_state(bars: DataFrame, n: int = 20, least: int = 5) -> DataFrame:
    """The mean of each symbol's last n closes as bars (symbol, ts, event_id, close) arrive, and whether enough have come."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        kept = np.array(state.get[0] if state.exists else [], float)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        closes = np.concatenate([kept, rows["close"].to_numpy(float)])
        ends = np.arange(len(kept) + 1, len(closes) + 1)
        starts = np.maximum(ends - n, 0)
        sums = np.append(0.0, np.cumsum(closes))
        state.update((closes[-n:].tolist(),))
        yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "mean": (sums[ends] - sums[starts]) / (ends - starts), "ready": ends - starts >= least})

    return bars.groupBy("symbol").applyInPandasWithState(run, "symbol string, ts timestamp, event_id long, mean double, ready boolean", "closes array<double>", "append", GroupStateTimeout.NoTimeout)


def append_bars(bars: DataFrame, path: str, checkpoint: str):
    """Write closed bars of what is there; called again, it goes on from its checkpoint."""
    return bars.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def last_rows(history: DataFrame, n: int = 20) -> DataFrame:
    """The last n rows of each symbol's history, from which a stream's state can start."""
    from pyspark.sql import Window

    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("event_id")))
    return history.withColumn("k", last).filter(F.col("k") <= n).drop("k")
