"""Spectra of rolling correlations between many instruments that don't all trade every day.

Days are numbered, instruments dealt to tiles, and spans of days meet tile against tile: a task multiplies the returns of two
tiles over each day's window, and gives sums over the days on which both of a pair traded.  A day's blocks then meet and
are one matrix, whose eigenvalues are found there.  So days and tiles are both worked on in parallel; a task holds a span of
two tiles, or one day's matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Instruments of a tile, and days of a span (a window is no longer than that).
TILE, SPAN = 32, 256
MEASURES = ("absorption", "entropy", "mean_corr", "max_corr", "dispersion")


def block_moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of columns: rows that both have, their covariance and their correlation over those rows; NaN is missing."""
    mx, my = (~np.isnan(v) for v in (x, y))
    x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    n = mx.T @ my
    sx, sy = x.T @ my, mx.T @ y
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = (x.T @ y - sx * sy / n) / (n - 1)
        vx, vy = ((x * x).T @ my - sx * sx / n) / (n - 1), (mx.T @ (y * y) - sy * sy / n) / (n - 1)
        corr = cov / np.sqrt(np.maximum(vx, 0) * np.maximum(vy, 0))
    return n, cov, corr


def absorption(values: np.ndarray, share: float) -> float:
    """Share of the fewest leading eigenvalues that reach `share` of their sum; values ascend."""
    v = np.maximum(values[::-1], 0)
    part = np.cumsum(v) / v.sum()
    return float(part[(part >= share).argmax()])


def entropy(values: np.ndarray) -> float:
    """Entropy of the eigenvalues' shares, over that of equal ones."""
    v = values[values > 1e-10 * max(values.max(), 0)]
    p = v / v.sum()
    return float(-(p * np.log(p)).sum() / np.log(len(p))) if len(p) > 1 else 0.0


def measures(n: np.ndarray, cov: np.ndarray, corr: np.ndarray, least: int, share: float) -> list[float] | None:
    """Of a day's matrices, over the instruments with `least` rows of their own; pairs that share fewer count as uncorrelated."""
    kept = np.flatnonzero((np.diag(n) >= least) & (np.diag(cov) > 0))
    if len(kept) < 2:
        return None
    n, cov, corr = (m[np.ix_(kept, kept)] for m in (n, cov, corr))
    known = (n >= least) & np.isfinite(corr)
    cov, corr = np.where(known, cov, 0.0), np.where(known, corr, 0.0)
    off = corr[~np.eye(len(kept), dtype=bool)]
    return [absorption(np.linalg.eigvalsh(corr), share), entropy(np.linalg.eigvalsh(cov)), off.mean(), np.abs(off).max(), off.std(), len(kept)]


def correlation_spectra(returns: DataFrame, window: int = 60, least: int = 30, share: float = 0.8, tile: int = TILE, span: int = SPAN) -> DataFrame:
    """(ts, absorption, entropy, mean_corr, max_corr, dispersion, instruments) of the `window` days before each day.

    returns: symbol, ts, r.  A day is one on which any instrument has a return; days before the first full window have no row,
    nor have days with fewer than two instruments of `least` returns.
    """
    if window > span:
        raise ValueError("a window can't be longer than a span")
    given = returns.select("symbol", "ts", F.col("r").cast("double").alias("r")).filter("symbol is not null and ts is not null and r is not null")
    days = given.select("ts").distinct().withColumn("day", F.row_number().over(Window.orderBy("ts")) - 1)  # a row a day
    names = given.select("symbol").distinct().withColumn("i", F.row_number().over(Window.orderBy("symbol")) - 1)  # a row an instrument
    n_days, n_names = days.count(), names.count()
    tiles = -(-n_names // tile)
    rows = given.join(days, "ts").join(names, "symbol").select("day", F.floor(F.col("i") / tile).cast("int").alias("t"), (F.col("i") % tile).cast("int").alias("slot"), "r")
    # a day is in the windows of its own span and, near the span's end, in those of the next
    spans = F.array_distinct(F.array(F.floor(F.col("day") / span), F.floor((F.col("day") + window) / span)))
    rows = rows.withColumn("s", F.explode(spans))
    others = F.explode(F.sequence(F.lit(0), F.lit(max(tiles - 1, 0))))
    pairs = rows.withColumn("o", others).select(F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), "s", "t", "day", "slot", "r")

    def width(t: int) -> int:
        return min(tile, n_names - t * tile)

    def blocks(key, table):
        a, b, s = (k.as_py() for k in key)
        first = max(s * span - window, 0)
        last = min((s + 1) * span, n_days)
        t, day, slot, r = (table.column(c).to_numpy() for c in ("t", "day", "slot", "r"))
        sides = []
        for side in (a, b):
            x = np.full((last - first, width(side)), np.nan)
            own = (t == side) & (day < last)
            x[day[own] - first, slot[own]] = r[own]
            sides.append(x)
        out = []
        for d in range(max(s * span, window), last):
            part = slice(d - window - first, d - first)
            out.append((d, a, b, np.stack(block_moments(sides[0][part], sides[1][part])).tobytes()))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({"day": pa.array(cols[0], pa.int32()), "a": pa.array(cols[1], pa.int32()), "b": pa.array(cols[2], pa.int32()), "block": pa.array(cols[3], pa.binary())})

    def spectrum(key, table):
        whole = np.full((3, n_names, n_names), np.nan)
        whole[0] = 0
        for a, b, raw in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), table.column("block").to_pylist(), strict=True):
            block = np.frombuffer(raw).reshape(3, width(a), width(b))
            i, j = slice(a * tile, a * tile + width(a)), slice(b * tile, b * tile + width(b))
            whole[:, i, j] = block
            whole[:, j, i] = block.transpose(0, 2, 1)
        got = measures(*whole, least, share)
        cols = [[v] for v in got] if got else [[]] * 6
        return pa.table({"day": pa.array([key[0].as_py()] if got else [], pa.int32()), **{c: pa.array(v, pa.float64()) for c, v in zip(MEASURES, cols, strict=False)}, "instruments": pa.array([int(v) for v in cols[5]], pa.int64())})

    moments = pairs.groupBy("a", "b", "s").applyInArrow(blocks, "day int, a int, b int, block binary")
    found = moments.groupBy("day").applyInArrow(spectrum, "day int, " + ", ".join(f"{c} double" for c in MEASURES) + ", instruments long")
    return found.join(days, "day").select("ts", *MEASURES, "instruments")
