"""Quality scores by a byte-level convolutional network in numpy.

A byte has a short learned vector, and one more number that says whether the eight bytes from it stand within the `LAGS`
bytes before, too; learned filters run over windows of `WIDTH` bytes; a filter's value for a document is
its largest over all windows, rectified; one logistic unit combines these values into a probability.  Documents are read
in chunks of `CHUNK` windows that overlap by `WIDTH` - 1 bytes, so that every window of the whole text is in one chunk,
and the maxima of a document's chunks are combined: memory doesn't grow with a text's length.

The network is fitted on a bounded sample: at most `SAMPLE` labelled documents of each class, none longer than `SAMPLE_BYTES`,
chosen by a hash of their ids.  It learns from the text and the label alone, with both classes weighted alike; a fifth of the
sample is kept apart to scale the scores, and the shares of the classes among all labelled documents set their prior.

Null and empty texts are read as one window of padding.  Without labels of both classes every score is the share of label
1, or 0.5 without any.  Of a doc_id labelled more than once the lowest label counts; rows of one doc_id are scored alike.
Rows without a doc_id are scored, not learned from, and not held out.  Other columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs
from .textops import text_buffer

#: Bytes of a window, numbers of a byte's vector, filters, and windows of a chunk.
WIDTH, DIM, FILTERS, CHUNK = 8, 4, 16, 1024
#: Bytes before a byte in which its next eight bytes are looked for, from the nearest distance to the farthest.
LAGS = range(2, 25)
#: Bounds of the sample: documents of a class, bytes of one.
SAMPLE, SAMPLE_BYTES = 800, 1 << 15
EPOCHS, BATCH, RATE = 14, 32, 0.01
HELD_OUT_MOD, THRESHOLD = 5, 0.3


@dataclass
class Network:
    vectors: np.ndarray  # (256, DIM)
    filters: np.ndarray  # (WIDTH * (DIM + 1), FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (FILTERS,)
    offset: float
    scale: tuple[float, float]  # of the calibrated score: factor and addition
    constant: float | None = None  # the score of every text, where nothing could be learned


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with `WIDTH` zero bytes after each, and where each begins: a window starts at each of a text's bytes, or at the padding of an empty one."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros(len(raw) + WIDTH * n, np.uint8)
    out[np.arange(len(raw)) + WIDTH * np.repeat(np.arange(n), size)] = raw
    return out, offsets[:-1] + WIDTH * np.arange(n)


def repeated(text: np.ndarray) -> np.ndarray:
    """1 at each byte whose next eight bytes stand a few bytes before, too; padding ends a text, so none reaches into another."""
    eight = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(7, np.uint8)), 8).copy().view(np.uint64).ravel()
    out = np.zeros(len(text), bool)
    for lag in LAGS:
        out[lag:] |= eight[lag:] == eight[:-lag]
    return (out & (eight != 0) & (text != 0)).astype(np.float32)


def pooled(net: Network, raw: np.ndarray, offsets: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each text's largest value of every filter, before it is rectified, and with `where` the byte at which that window starts."""
    text, begin = padded(raw, offsets)
    size = np.maximum(np.diff(offsets), 1)
    per = -(-size // CHUNK)
    owner = np.repeat(np.arange(len(size)), per)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    first = begin[owner] + place * CHUNK
    last = np.minimum(first + CHUNK, begin[owner] + size[owner])
    again = repeated(text)
    most = np.empty((len(owner), FILTERS), np.float32)
    at = np.empty((len(owner), FILTERS), np.int64) if where else None
    i = 0
    while i < len(owner):  # some chunks at a time
        j = max(i + 1, int(np.searchsorted(last, first[i] + 16 * CHUNK, side="right")))
        a, b = int(first[i]), int(last[j - 1])
        x = np.empty((b + WIDTH - 1 - a, DIM + 1), np.float32)
        x[:, :DIM] = net.vectors[text[a : b + WIDTH - 1]]
        x[:, DIM] = again[a : b + WIDTH - 1]
        windows = np.lib.stride_tricks.sliding_window_view(x.ravel(), WIDTH * (DIM + 1))[:: DIM + 1]
        values = windows @ net.filters
        if where:
            for k in range(i, j):
                part = values[first[k] - a : last[k] - a]
                at[k] = part.argmax(0) + first[k]
                most[k] = part.max(0)
        else:
            cuts = np.stack([first[i:j] - a, last[i:j] - a], 1).ravel()
            cuts = cuts[:-1] if cuts[-1] == len(values) else cuts
            most[i:j] = np.maximum.reduceat(values, cuts)[::2]
        i = j
    most += net.bias
    heads = np.cumsum(per) - per
    best = np.maximum.reduceat(most, heads) if len(heads) else np.zeros((0, FILTERS), np.float32)
    if not where:
        return best, None
    chosen = np.empty((len(size), FILTERS), np.int64)
    for d, (h, n) in enumerate(zip(heads.tolist(), per.tolist(), strict=True)):
        chosen[d] = at[h + most[h : h + n].argmax(0), np.arange(FILTERS)]
    return best, chosen


def _logit(net: Network, best: np.ndarray) -> np.ndarray:
    return np.maximum(best, 0).astype(np.float64) @ net.weights.astype(np.float64) + net.offset


def scores(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each text."""
    if net.constant is not None:
        return np.full(len(offsets) - 1, net.constant)
    best, _ = pooled(net, raw, offsets)
    return 1 / (1 + np.exp(-np.clip(_logit(net, best) * net.scale[0] + net.scale[1], -50, 50)))


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss, by the windows that give the maxima."""
    raw, offsets = _buffer(texts)
    best, chosen = pooled(net, raw, offsets, where=True)
    text, _ = padded(raw, offsets)
    wrong = (1 / (1 + np.exp(-np.clip(_logit(net, best), -50, 50))) - labels) / len(labels)
    live = (best > 0) * net.weights * wrong[:, None]  # (documents, FILTERS)
    places = chosen[:, :, None] + np.arange(WIDTH)  # (documents, FILTERS, WIDTH)
    bytes_at = text[places]
    seen = np.concatenate([net.vectors[bytes_at], repeated(text)[places][..., None]], 3).reshape(len(texts), FILTERS, -1)
    filters = np.einsum("dfk,df->kf", seen, live)
    back = live[:, :, None] * net.filters.T[None]  # (documents, FILTERS, WIDTH * (DIM + 1))
    vectors = np.zeros_like(net.vectors, dtype=np.float64)
    np.add.at(vectors, bytes_at.ravel(), back.reshape(-1, DIM + 1)[:, :DIM])
    return [vectors, filters, live.sum(0), np.maximum(best, 0).T @ wrong, np.array([wrong.sum()])]


def _scaled(logits: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Factor and addition that fit the logits of documents kept apart, with both classes weighted alike, and then the prior."""
    weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    soft = np.where(labels == 1, 1 - 1 / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps on two numbers
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -50, 50)))
        g = np.array([(weight * (p - soft) * logits).sum() + 1e-4 * (a - 1), (weight * (p - soft)).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * logits * logits).sum() + 1e-4, (h * logits).sum()], [(h * logits).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 0.05)), float(b + np.log(prior / (1 - prior)))


def train(texts: list[bytes], labels: list[int], prior: float, seed: int = 11) -> Network:
    """A network fitted to texts and labels 0 and 1; prior: the share of label 1 where it is to be used."""
    labels = np.array(labels, np.float64)
    if not 0 < labels.sum() < len(labels):
        return Network(*[np.zeros(0)] * 4, 0.0, (1.0, 0.0), float(prior))
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * (DIM + 1), FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0, (1.0, 0.0),
    )
    order = rng.permutation(len(texts))
    apart, fitted = order[: len(order) // 5], order[len(order) // 5 :]
    groups = [fitted[labels[fitted] == c] for c in (0, 1)]
    steps = EPOCHS * (max(len(fitted) // BATCH, 8))
    moments = None
    for step in range(steps):
        if min(map(len, groups)):
            some = np.concatenate([rng.choice(g, BATCH // 2, replace=len(g) < BATCH // 2) for g in groups])
        else:
            some = rng.choice(fitted, BATCH)
        grads = _gradients(net, [texts[i] for i in some], labels[some])
        moments = moments or [(np.zeros(g.shape), np.zeros(g.shape)) for g in grads]
        values = [net.vectors, net.filters, net.bias, net.weights, np.array([net.offset])]
        rate = RATE * (1 - step / steps) + 1e-4
        for k, (g, v) in enumerate(zip(grads, values, strict=True)):
            if k < 4:
                g = g + 1e-4 * v
            m, s = moments[k]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(v.dtype)
        net.offset = float(values[4][0])
    check = apart if 0 < labels[apart].sum() < len(apart) else order
    raw, offsets = _buffer([texts[i] for i in check])
    net.scale = _scaled(_logit(net, pooled(net, raw, offsets)[0]), labels[check], min(max(prior, 0.01), 0.99))
    return net


def held_out(mod: int = HELD_OUT_MOD):
    """Whether a doc_id is left out of what is learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from documents (doc_id, text) and labels (doc_id, quality), none of them held out.

    The driver gets two counts and at most 2 * `sample` texts of at most `SAMPLE_BYTES`.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = dict(known.groupBy("quality").count().collect())
    total = sum(counts.values())
    short = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    texts, marks = [], []
    if len(counts) == 2:
        for c in sorted(counts):
            ids = known.filter(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
            rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
            texts += [r["text"].encode() for r in rows]
            marks += [c] * len(rows)
    return train(texts, marks, counts.get(1, 0) / total if total else 0.5)


def _score(net: Network):
    def run(batches):
        for batch in jobs.slices(batches):
            found = scores(net, *text_buffer(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found)], ["doc_id", "held_out", "score"])

    return run


def quality(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): the probability of label 1, and 1 where it is at least `threshold`."""
    key = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(jobs.tidy(_score(net)), f"doc_id {key}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
