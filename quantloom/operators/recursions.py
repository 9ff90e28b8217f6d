"""Recursions over series: exponential means, conditional variance, run-length posteriors and optimal segments.

Spark deals rows by key, sorts them, and streams them in batches through a task; a small state is carried from batch to
batch and starts anew with each key.  Memory is the state's, whatever the length of a series.  Columns are added to the
rows, which keep their other columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BLOCK = 128


def decayed(x: np.ndarray, keep: float, carry: float) -> np.ndarray:
    """y[t] = keep * y[t - 1] + x[t], with `carry` before the first; a block of rows is one product."""
    power = keep ** np.arange(_BLOCK + 1)
    lag = np.subtract.outer(np.arange(_BLOCK), np.arange(_BLOCK))
    weight = np.where(lag >= 0, power[np.maximum(lag, 0)], 0.0)
    out = np.empty(len(x))
    for a in range(0, len(x), _BLOCK):
        part = x[a : a + _BLOCK]
        n = len(part)
        out[a : a + n] = weight[:n, :n] @ part + power[1 : n + 1] * carry
        carry = out[a + n - 1]
    return out


class Means:
    """Adjusted exponential means: weights fall by 1 - 2 / (span + 1) a row.  A mean may be of another mean's columns."""

    def __init__(self, spans: Mapping[str, tuple[Callable[[Mapping[str, np.ndarray]], np.ndarray], int]]):
        self.spans, self.carry = spans, {name: (0.0, 0.0) for name in spans}

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for name, (of, span) in self.spans.items():
            x, keep, (v, w) = of(columns | out), 1 - 2 / (span + 1), self.carry[name]
            top, bottom = decayed(x, keep, v), decayed(np.ones(len(x)), keep, w)
            self.carry[name] = top[-1], bottom[-1]
            out[name] = top / bottom
        return out


class Variance:
    """h[t] = omega + alpha * r[t - 1]^2 + beta * h[t - 1], from the series' variance `v`; omega keeps that variance."""

    def __init__(self, alpha: float = 0.05, beta: float = 0.90):
        self.alpha, self.beta, self.h, self.last = alpha, beta, None, 0.0

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        r, v = columns["r"], float(columns["v"][0])
        omega = max(v * (1 - self.alpha - self.beta), 1e-10)
        shock = omega + self.alpha * np.append(self.last, r[:-1]) ** 2
        if self.h is None:
            h = np.append(v, decayed(shock[1:], self.beta, v)) if len(r) > 1 else np.array([v])
        else:
            h = decayed(shock, self.beta, self.h)
        self.h, self.last = h[-1], r[-1]
        h = np.maximum(h, 1e-10)
        return {"h": h, "eta": r / np.sqrt(h)}


class Correlation:
    """q[t] = (1 - a - b) * q0 + a * x[t - 1] * y[t - 1] + b * q[t - 1] for both variances and the product."""

    def __init__(self, a: float = 0.01, b: float = 0.95):
        self.a, self.b, self.q, self.last = a, b, None, (0.0, 0.0)

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, y, rho = columns["x"], columns["y"], float(columns["rho"][0])
        px, py = np.append(self.last[0], x[:-1]), np.append(self.last[1], y[:-1])
        start = (1.0, 1.0, rho)
        paths = []
        for k, product in enumerate((px * px, py * py, px * py)):
            step = (1 - self.a - self.b) * start[k] + self.a * product
            if self.q is None:
                paths.append(np.append(start[k], decayed(step[1:], self.b, start[k])) if len(x) > 1 else np.array([start[k]]))
            else:
                paths.append(decayed(step, self.b, self.q[k]))
        self.q, self.last = tuple(p[-1] for p in paths), (x[-1], y[-1])
        return {"dcc": paths[2] / np.sqrt(np.maximum(paths[0], 1e-12) * np.maximum(paths[1], 1e-12))}


class RunLengths:
    """Posterior of the time since the last change, for normal values with a normal-inverse-gamma prior.

    Gives the weight of a change at each row, the expected run length, and the mean at it.  Run lengths above
    `longest` are cut off and the rest is scaled to 1, so that the state is bounded.
    """

    def __init__(self, hazard: float = 0.01, mu: float = 0.0, kappa: float = 1.0, alpha: float = 1.0, beta: float = 1.0, longest: int = 500):
        self.hazard, self.mu, self.kappa, self.alpha, self.beta, self.longest = hazard, mu, kappa, alpha, beta, longest
        self.p, self.n, self.sum, self.square = np.ones(1), np.zeros(1), np.zeros(1), np.zeros(1)
        half = [math.lgamma(alpha + k / 2) for k in range(longest + 3)]
        self.gamma = np.diff(half)  # by the values of a run: each adds a half to the shape of the variance

    def posterior(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mean, its weight, and shape and rate of the variance, by run length; a run of length 0 has the prior."""
        n, total, square = self.n.copy(), self.sum.copy(), self.square.copy()
        n[0] = total[0] = square[0] = 0.0
        mean, kappa = total / np.maximum(n, 1), self.kappa + n
        spread = np.maximum(square - n * mean**2, 0)
        beta = self.beta + 0.5 * spread + self.kappa * n * (mean - self.mu) ** 2 / (2 * kappa)
        return (self.kappa * self.mu + total) / kappa, kappa, self.alpha + n / 2, beta

    def step(self, x: float) -> tuple[float, float, float]:
        mu, kappa, alpha, beta = self.posterior()
        df, scale = 2 * alpha, np.sqrt(beta * (kappa + 1) / (alpha * kappa))
        density = np.exp(self.gamma[np.rint(df - 2 * self.alpha).astype(np.int64)] - 0.5 * np.log(df * math.pi) - np.log(scale) - (df + 1) / 2 * np.log1p(((x - mu) / scale) ** 2 / df))
        reached = self.p * density
        change = self.hazard * reached.sum()
        p = np.append(change, (1 - self.hazard) * reached)
        if p.sum() <= 1e-300:  # nothing explains the value: it is as likely a start as not
            p = np.append([0.5, 0.5], np.zeros(len(p) - 2))
        keep = slice(0, self.longest)
        self.n = np.append(1.0, self.n + 1)[keep]
        self.sum, self.square = np.append(x, self.sum + x)[keep], np.append(x * x, self.square + x * x)[keep]
        self.p = p[keep] / p[keep].sum()
        expected = float((np.arange(len(self.p)) * self.p).sum())
        return float(change), expected, float(self.posterior()[0][int(expected)])

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        got = [self.step(x) for x in columns["x"].tolist()]
        change, run, mean = (np.array(c, float) for c in zip(*got, strict=True))
        return {"change": change, "run_length": run, "mean": mean}


class Exposure:
    """The sum of a key's last n signed values, its side (1 long, -1 short), and the side before it (0 for a first row)."""

    def __init__(self, n: int = 5):
        self.n, self.values, self.side = n, np.zeros(0), 0.0

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        values = np.concatenate([self.values, columns["signed"]])
        sums = np.append(0.0, np.cumsum(values))
        ends = np.arange(len(self.values) + 1, len(values) + 1)
        total = sums[ends] - sums[np.maximum(ends - self.n, 0)]
        side = np.where(total >= 0, 1.0, -1.0)
        was = np.append(self.side, side[:-1])
        self.values, self.side = values[-(self.n - 1) :] if self.n > 1 else np.zeros(0), side[-1]
        return {"exposure": total, "was": was, "side": side}


class LastMean:
    """Mean of a key's last n closes, and of how many it is."""

    def __init__(self, n: int = 20):
        self.n, self.close = n, np.zeros(0)

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        values = np.concatenate([self.close, columns["close"]])
        sums = np.append(0.0, np.cumsum(values))
        ends = np.arange(len(self.close) + 1, len(values) + 1)
        count = np.minimum(ends, self.n)
        self.close = values[-(self.n - 1) :] if self.n > 1 else np.zeros(0)
        return {"mean": (sums[ends] - sums[ends - count]) / count, "n": count.astype(float)}


class Moves:
    """Direction of a key's last n moves of the close: 1 or -1 where all went one way, else 0."""

    def __init__(self, n: int = 3):
        self.n, self.close, self.signs = n, np.nan, np.zeros(0)

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        close = columns["close"]
        step = np.sign(close - np.append(self.close, close[:-1]))  # NaN for a first row
        signs = np.concatenate([self.signs, step])
        same = np.array([len(w) == self.n and abs(w.sum()) == self.n for w in (signs[max(i - self.n, 0) : i] for i in range(len(self.signs) + 1, len(signs) + 1))])
        self.close, self.signs = close[-1], signs[-(self.n - 1) :] if self.n > 1 else np.zeros(0)
        return {"signal": np.where(same, step, 0.0)}


class Segments:
    """Optimal segments under a normal cost, found as rows come, with the candidates that can't win any more cut off.

    A row's `segments` is the number of segments in the best division of the series up to it, and `segment_start` the
    row at which the last of them began; `penalty` is that of the whole series, given as a column.
    """

    def __init__(self, least: int = 5):
        self.least, self.n, self.best, self.count = least, 0, {0: 0.0}, {0: 0}
        self.sums = {0: (0.0, 0.0)}  # of values and squares before each candidate
        self.open, self.total = [0], (0.0, 0.0)

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, penalty = columns["x"], float(columns["penalty"][0])
        start, count = np.zeros(len(x)), np.zeros(len(x))
        for i, v in enumerate(x.tolist()):
            self.n += 1
            self.total = self.total[0] + v, self.total[1] + v * v
            ready = [s for s in self.open if self.n - s >= self.least]
            if ready:
                at = np.array(ready, float)
                size = self.n - at
                before = np.array([self.sums[s] for s in ready])
                mean = (self.total[0] - before[:, 0]) / size
                var = np.maximum((self.total[1] - before[:, 1]) / size - mean**2, 1e-10)
                cost = np.array([self.best[s] for s in ready]) + size / 2 * (math.log(2 * math.pi) + np.log(var) + 1) + penalty
                k = int(cost.argmin())
                self.best[self.n], self.count[self.n] = float(cost[k]), self.count[ready[k]] + 1
                start[i], count[i] = ready[k], self.count[self.n]
                lost = {s for s, c in zip(ready, cost.tolist(), strict=True) if c - penalty > self.best[self.n]}
            else:
                self.best[self.n], self.count[self.n], lost = math.inf, 1, set()
                count[i] = 1
            self.open = [s for s in self.open if s not in lost] + [self.n]
            self.sums[self.n] = self.total
            for s in lost:
                for table in (self.sums, self.best, self.count):
                    table.pop(s, None)
        return {"segment_start": start, "segments": count}


def _values(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.cast(column, pa.float64()), math.nan))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object], added: str) -> DataFrame:
    """The rows with the columns that a recursion adds: start() gives a state whose push(columns) takes a run of rows.

    added: the new columns, as in a schema.  Numeric columns reach the recursion as doubles, null as NaN.
    """
    schema = StructType.fromDDL(added)
    names = [f.name for f in schema]
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte") or f.dataType.typeName().startswith("decimal")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            turn = np.zeros(n, bool)
            for k in keys:
                c = batch.column(k)
                turn[1:] |= np.asarray(pc.fill_null(pc.not_equal(c[1:], c[:-1]), False)) | (np.asarray(c[1:].is_valid()) != np.asarray(c[:-1].is_valid()))
            values = {c: _values(batch.column(c)) for c in numeric}
            cuts = [0, *np.flatnonzero(turn).tolist(), n]
            out: dict[str, list[np.ndarray]] = {c: [] for c in names}
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(batch.column(k)[a].as_py() for k in keys)
                if state is None or key != current:
                    state, current = start(), key
                for c, v in state.push({c: v[a:b] for c, v in values.items()}).items():
                    out[c].append(v)
            new = [pa.array(np.concatenate(out[c]), pa.float64(), from_pandas=True) for c in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    rows = df.repartition(*map(F.col, keys)).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(run, StructType([*df.schema, *schema]))


def pooled_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str = "r", piece: int = 512, rounds: int = 30, tolerance: float = 1e-4, floor: float = 1e-3) -> tuple[DataFrame, dict]:
    """Two hidden states with normal values, fitted over all series at once, and each row's filtered probabilities.

    Series are cut in pieces of `piece` rows, each started from the states' shares: a task holds one piece at a time.
    In each round a piece gives its expected counts and moments, and only their sum returns.  State 0 has the smaller
    deviation.  Returns the rows with p0, p1 and the expected probability of a switch, and the fitted parameters.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.filter(F.col(x).isNotNull()).withColumn("piece_", F.floor((F.row_number().over(w) - 1) / piece))
    whole = rows.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).first()
    if whole.m is None:
        whole = type(whole)(m=0.0, s=1.0)
    spread = max(whole.s, floor)
    params = {"mean": [whole.m, whole.m], "dev": [0.5 * spread, 1.5 * spread], "stay": [0.95, 0.95], "first": [0.5, 0.5]}
    small = rows.select(*keys, "piece_", *order, x)
    moments = ["first0", "first1", "n00", "n01", "n10", "n11", "w0", "w1", "x0", "x1", "q0", "q1", "loglik"]
    last = None
    for _ in range(rounds):
        stats = small.groupBy(*keys, "piece_").applyInArrow(_expected(params, x, list(order), moments), ", ".join(f"{m} double" for m in moments))
        t = stats.agg(*[F.sum(m).alias(m) for m in moments]).first()
        if t.loglik is None or last is not None and abs(t.loglik - last) <= tolerance * abs(last):
            break
        last = t.loglik
        w_ = [max(t.w0, 1e-12), max(t.w1, 1e-12)]
        mean = [t.x0 / w_[0], t.x1 / w_[1]]
        dev = [max(math.sqrt(max(q / n - m * m, 0)), floor * spread) for q, n, m in zip((t.q0, t.q1), w_, mean, strict=True)]
        total = max(t.first0 + t.first1, 1e-12)
        params = {"mean": mean, "dev": dev, "stay": [t.n00 / max(t.n00 + t.n01, 1e-12), t.n11 / max(t.n10 + t.n11, 1e-12)], "first": [t.first0 / total, t.first1 / total]}
    if params["dev"][0] > params["dev"][1]:
        params = {k: v[::-1] for k, v in params.items()}
    fitted = params
    return scan(rows.drop("piece_"), keys, order, lambda: Filter(fitted, x), "p0 double, p1 double, switch double"), params


class Filter:
    """Probabilities of two fitted states given the rows so far."""

    def __init__(self, params: dict, x: str):
        self.params, self.x, self.p = params, x, None

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        s0, s1 = self.params["stay"]
        move = np.array([[s0, 1 - s0], [1 - s1, s1]])
        density, out = _density(columns[self.x], self.params), np.empty((len(columns[self.x]), 2))
        for t, d in enumerate(density):
            p = (np.array(self.params["first"]) if self.p is None else self.p @ move) * d
            self.p = p / max(p.sum(), 1e-300)
            out[t] = self.p
        return {"p0": out[:, 0], "p1": out[:, 1], "switch": out[:, 0] * (1 - s0) + out[:, 1] * (1 - s1)}


def _density(x: np.ndarray, params: dict) -> np.ndarray:
    m, s = np.array(params["mean"]), np.array(params["dev"])
    z = (x[:, None] - m) / s
    return np.maximum(np.exp(-0.5 * z * z) / s, 1e-300)


def _expected(params: dict, x: str, order: list[str], moments: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        v = np.asarray(table.column(x))
        n, density = len(v), _density(v, params)
        s0, s1 = params["stay"]
        move = np.array([[s0, 1 - s0], [1 - s1, s1]])
        ahead, scale = np.empty((n, 2)), np.empty(n)
        p = np.array(params["first"])
        for t in range(n):
            p = (p if t == 0 else p @ move) * density[t]
            scale[t] = p.sum()
            p = ahead[t] = p / scale[t]
        back = np.ones((n, 2))
        for t in range(n - 2, -1, -1):
            back[t] = move @ (density[t + 1] * back[t + 1]) / scale[t + 1]
        post = ahead * back
        post /= post.sum(axis=1, keepdims=True)
        pair = ahead[:-1, :, None] * move * (density[1:] * back[1:] / scale[1:, None])[:, None, :]
        got = [*post[0], *pair.sum(axis=0).ravel(), *post.sum(axis=0), *(post * v[:, None]).sum(axis=0), *(post * v[:, None] ** 2).sum(axis=0), np.log(scale).sum()]
        return pa.table({m: [float(g)] for m, g in zip(moments, got, strict=True)})

    return run
