"""Market files: bars, option days, partitioned stores.

Schemas are declared, filters reach the scan, and file names that carry a date or a symbol become columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which sources keep a bar's columns, by the name used here.
ALIASES = {"ts": ("ts", "timestamp", "window_start", "ts_event", "date"), "symbol": ("symbol", "ticker"), "open": ("open", "o"), "high": ("high", "h"), "low": ("low", "l"), "close": ("close", "c"), "volume": ("volume", "vol", "v")}
OPTION_DAY = "ticker string, volume long, open double, close double, high double, low double, window_start long, transactions long"


def normalize_columns(df: DataFrame, required: Sequence[str] = ("ts", "open", "high", "low", "close")) -> DataFrame:
    """Known aliases in any case become the names used here; a missing volume is 0, another missing column an error."""
    here = {c.lower(): c for c in df.columns}
    found = {name: here[a] for name, names in ALIASES.items() for a in reversed(names) if a in here}
    if missing := [c for c in required if c not in found]:
        raise ValueError(f"missing columns: {missing}")
    out = df.withColumnsRenamed({old: new for new, old in found.items() if old != new})
    return out if "volume" in found else out.withColumn("volume", F.lit(0.0))


def scan_bars(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
    """Bars of a Parquet store; symbol and time filters are pushed to the scan."""
    df = normalize_columns(spark.read.parquet(path))
    if symbols:
        df = df.filter(F.col("symbol").isin(*symbols))
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start))
    return df if end is None else df.filter(F.col("ts") < F.lit(end))


def parse_contract(df: DataFrame, column: str = "ticker") -> DataFrame:
    """root, expiry, opt and strike of option codes `O:` root YYMMDD C or P strike x 1000; other rows are dropped."""
    pattern = r"^O:([A-Z.]+\d?)(\d{6})([CP])(\d{8})$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    out = df.filter(F.col(column).rlike(pattern))
    day = F.try_to_timestamp(part(2), F.lit("yyMMdd")).cast("date")
    expiry = F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)  # two digits from 69 on are of the last century
    out = out.withColumns({"root": part(1), "expiry": expiry, "opt": part(3), "strike": part(4).cast("double") / 1000})
    return out.filter(F.col("expiry").isNotNull())


def scan_option_days(spark: SparkSession, path: str, root: str | None = None, start=None, end=None, date_column: str = "") -> DataFrame:
    """Gzip CSV files of a day each, named YYYY-MM-DD or in a folder date_column=YYYY-MM-DD; the date comes from that name."""
    df = spark.read.schema(OPTION_DAY).csv(path, header=True)
    name, pattern = ("_metadata.file_path", rf"{date_column}=(\d{{4}}-\d{{2}}-\d{{2}})") if date_column else ("_metadata.file_name", r"(\d{4}-\d{2}-\d{2})")
    df = df.withColumn("date", F.regexp_extract(F.col(name), pattern, 1).cast("date"))
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end))
    df = parse_contract(df)
    if root:
        df = df.filter(F.col("root") == root)
    return df.withColumns({"dte": F.datediff("expiry", "date"), "ts": F.timestamp_micros(F.expr("window_start div 1000"))})


def scan_futures(spark: SparkSession, path: str, symbol: str, timeframe: str = "1m", columns: Sequence[str] | None = None) -> DataFrame:
    """Files named {symbol}_ohlcv_{timeframe}_*.parquet."""
    df = normalize_columns(spark.read.parquet(f"{path.rstrip('/')}/{symbol}_ohlcv_{timeframe}_*.parquet")).withColumn("symbol", F.lit(symbol))
    return df.select(*columns) if columns else df


def write_partitioned(df: DataFrame, path: str, mode: str = "append", day: str = "ts") -> None:
    """One directory for each symbol and day, zstd; a key's rows are together, and large keys split by row count."""
    out = df.withColumn("date", F.to_date(day)).repartition("symbol", "date")
    out.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", 5_000_000).partitionBy("symbol", "date").parquet(path)


def missing_days(days: DataFrame, store: DataFrame) -> DataFrame:
    """The days (symbol, date) that the store lacks."""
    return days.join(store.select("symbol", "date").distinct(), ["symbol", "date"], "left_anti")


def upsert_latest(table: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The latest row of each key of both tables."""
    both = table.unionByName(new)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), F.col(order)).alias("row")).select("row.*")


def load_macro(series: DataFrame, start: str, end: str, names: Sequence[str]) -> DataFrame:
    """Long (series_id, date, value) to daily columns, each filled forward; the days come from a sequence."""
    from pyspark.sql import Window

    days = series.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    wide = series.groupBy("date").pivot("series_id", list(names)).agg(F.max("value"))
    # a row a day: one partition holds the calendar, not the data
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.join(wide, "date", "left").select("date", *[F.last(n, ignorenulls=True).over(w).alias(n) for n in names])


def write_features(df: DataFrame, path: str) -> None:
    """One folder of features for each symbol, in order of time."""
    df.repartition("symbol").sortWithinPartitions("symbol", "ts").write.option("compression", "zstd").partitionBy("symbol").parquet(path)


def load_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Events (ts, event_name, impact) of a CSV file with timestamp, event_name and impact_level; rows without a time go."""
    df = spark.read.schema("timestamp timestamp, event_name string, impact_level string").csv(path, header=True)
    return df.filter("timestamp is not null").select(F.col("timestamp").alias("ts"), "event_name", F.upper("impact_level").alias("impact"))


def read_trade_paths(spark: SparkSession, path: str) -> DataFrame:
    """Nested trade records as a row a day, with the peak so far and a label by how near the day is to the trade's peak."""
    schema = "trade_id long, entry struct<spot: double>, path array<struct<day: int, pnl: double, spot: double>>, exit struct<final_pnl: double, peak: double>"
    days = spark.read.schema(schema).json(path).select("trade_id", F.col("exit.peak").alias("peak"), "path", F.posexplode("path").alias("at", "row"))
    so_far = F.array_max(F.transform(F.slice("path", F.lit(1), F.col("at") + 1), lambda x: x["pnl"]))
    label = F.when(F.col("peak") <= 20, "peakless").when(F.col("row.pnl") >= 0.8 * F.col("peak"), "near_peak").otherwise("off_peak")
    return days.select("trade_id", "row.day", "row.pnl", so_far.alias("peak_so_far"), label.alias("label"))


def lake_sql(spark: SparkSession, views: dict[str, DataFrame], text: str) -> DataFrame:
    """SQL over named views; the names are the query's own and hold for it alone."""
    return spark.sql(_named_views(text, views), **views)


def _named_views(text: str, views: dict[str, DataFrame]) -> str:
    import re

    return re.sub(r"\b(" + "|".join(map(re.escape, views)) + r")\b", r"{\1}", text)
