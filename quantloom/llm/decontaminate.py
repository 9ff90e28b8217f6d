"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton is built over word hashes of normalised items, and documents' words stream through it, which keeps the
longest length matched at each word.  Only runs of words whose neighbouring pairs all occur in items are streamed: a
window lies inside such a run, so nothing is lost.  A window is `WINDOW` consecutive item words, or a whole shorter item.

The items go to the tasks in blocks of at most `BLOCK_BYTES` of text, one automaton each, so what is broadcast has that
bound whatever the size of the benchmark; with several blocks the spans of equal rows are united afterwards, and each of
the rows is given.

Null and empty texts have no words and no hits; items without words give no window.  Repeated rows are judged alike.
Rows without a doc_id are judged like others.  Extra columns are ignored.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs
from .textops import ALNUM, Words, runs, text_buffer, window_hashes

WINDOW = 10
#: Text of the items in one automaton.
BLOCK_BYTES = 8 << 20


class Automaton:
    """Suffix automaton of several word sequences, with the items that hold each state's windows."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.items: list[set[str]] = [set() for _ in self.next]
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for name, words in items:
            state = 0
            for w in words:
                state = self.next[state][w]
                at = state
                while at and self.length[at] >= window and name not in self.items[at]:
                    self.items[at].add(name)
                    at = self.link[at]
            if 0 < len(words) < window:
                self.short[state].append((len(words), name))
        # the ancestor of a state that holds its suffix of `window` words, and the nearest one where short items end
        self.top, self.near = [0] * len(self.next), [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.top[s] = self.top[up] if self.length[up] >= window else s
            self.near[s] = s if self.short[s] else self.near[up]
        known = {w for _, words in items for w in words}
        self.known = np.array(sorted(known), np.uint64)
        pairs = [window_hashes(np.array(words, np.uint64), 2) for _, words in items if len(words) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.least = min((min(len(words), window) for _, words in items if words), default=0)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def stream(self, words: list[int]):
        """Yield (end, length of the longest window ending there, items) for each word at which a window ends."""
        state, matched = 0, 0
        for end, w in enumerate(words, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            else:
                continue
            long = matched >= self.window
            found = self.items[self.top[state]] if long else set()
            size = self.window if long else 0
            at = self.near[state]
            while at:
                for n, name in self.short[at]:
                    if n <= matched:
                        found, size = found | {name}, max(size, n)
                at = self.near[self.link[at]]
            if size:
                yield end, size, found


def _isin(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    i = np.searchsorted(sorted_values, x)
    i[i == len(sorted_values)] = 0
    return sorted_values[i] == x


def _spans(words: Words, a: Automaton):
    """(row, first word, end, items) of the windows in a batch."""
    h = words.hashes
    if not len(h) or not a.least:
        return
    known = _isin(h, a.known)
    row_of = words.row_of()
    pair = np.zeros(len(h), bool)  # at i: words i and i + 1 stand together in an item
    both = np.flatnonzero(known[:-1] & known[1:] & (row_of[:-1] == row_of[1:]))
    if len(both):
        with np.errstate(over="ignore"):
            two = window_hashes(np.stack([h[both], h[both + 1]], 1).ravel(), 2)[::2]
        pair[both[_isin(two, a.pairs)]] = True
    start, end = runs(pair, np.array([0, len(h)]))
    end = end + 1
    long = end - start >= a.least
    start, end = start[long], end[long]
    if a.least == 1:
        alone = known.copy()
        alone[:-1] &= ~pair[:-1]
        alone[1:] &= ~pair[:-1]
        at = np.flatnonzero(alone)
        start, end = np.append(start, at), np.append(end, at + 1)
        order = np.argsort(start)
        start, end = start[order], end[order]
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        for stop, size, items in a.stream(h[s:e].tolist()):
            yield int(row_of[s]), s + stop - size, s + stop, items


_OUT = "row_key long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def _scan(automaton, all_rows: bool):
    def run(batches):
        a = automaton.value
        for batch in jobs.slices(batches):
            words = Words(batch.column("text"), ALNUM, True)
            n = batch.num_rows
            starts, ends, items = [[] for _ in range(n)], [[] for _ in range(n)], [set() for _ in range(n)]
            for row, s, e, found in _spans(words, a):
                s, e = s - int(words.rows[row]), e - int(words.rows[row])
                if ends[row] and s <= ends[row][-1]:
                    while starts[row] and starts[row][-1] > s:
                        starts[row].pop(), ends[row].pop()
                    if ends[row] and s <= ends[row][-1]:
                        ends[row][-1] = e
                    else:
                        starts[row].append(s), ends[row].append(e)
                else:
                    starts[row].append(s), ends[row].append(e)
                items[row] |= found
            out = pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), pa.array(words.counts), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                ["row_key", "doc_id", "n_words", "starts", "ends", "items"],
            )
            yield out if all_rows else out.filter(pa.array([bool(x) for x in starts]))

    return run


def _united(batches):
    """Unite the spans that several automata found in a document."""
    for batch in batches:
        starts, ends, items = [], [], []
        for s, e, i in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), batch.column("items").to_pylist(), strict=True):
            cover: list[list[int]] = []
            for a, b in sorted(zip(s, e, strict=True)):
                if cover and a <= cover[-1][1]:
                    cover[-1][1] = max(b, cover[-1][1])
                else:
                    cover.append([a, b])
            starts.append([a for a, _ in cover]), ends.append([b for _, b in cover]), items.append(sorted(set(i)))
        arrays = [pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row_key", "doc_id", "n_words")] + arrays + [batch.column("_rows")], ["row_key", "doc_id", "n_words", "starts", "ends", "items", "_rows"])


def _item_words(rows) -> list[tuple[str, list[int]]]:
    words = Words(pa.array([r.text for r in rows], pa.string()), ALNUM, True)
    return [(str(r.item_id), words.hashes[a:b].tolist()) for r, a, b in zip(rows, words.rows[:-1], words.rows[1:], strict=True)]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row_key, doc_id, n_words, the disjoint word spans [start, end) that test items hold, and the item ids.

    docs: doc_id, text, row_key.  benchmark: item_id, text.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = 1 + size // block_bytes
    found = None
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # one block: its size is bounded
        automaton = spark.sparkContext.broadcast(Automaton(_item_words(rows), window))
        part = docs.mapInArrow(jobs.tidy(_scan(automaton, b == 0)), _OUT).withColumn("_rows", F.lit(int(b == 0)))  # the first block gives every row
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.groupBy("row_key", "doc_id", "n_words").agg(flat("starts"), flat("ends"), flat("items"), F.sum("_rows").alias("_rows"))
        found = found.mapInArrow(jobs.tidy(_united), f"{_OUT}, _rows long").withColumn("_rows", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
    return found.drop("_rows")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    spans = contaminated_spans(docs, benchmark, window, block_bytes)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return spans.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def _cut(coverage: float, starts: str, ends: str):
    def run(batches):
        for batch in jobs.slices(batches):
            col = batch.column("text")
            words = Words(col, ALNUM, True)
            raw, off = text_buffer(col)
            texts = []
            for r, (s, e) in enumerate(zip(batch.column(starts).to_pylist(), batch.column(ends).to_pylist(), strict=True)):
                if not s:
                    texts.append(col[r].as_py())
                    continue
                if sum(e) - sum(s) > coverage * int(words.counts[r]):
                    texts.append(None)
                    continue
                at, out = int(off[r]), []
                for a, b in zip(s, e, strict=True):
                    out.append(raw[at : words.starts[words.rows[r] + a]].tobytes())
                    at = int(words.ends[words.rows[r] + b - 1])
                out.append(raw[at : off[r + 1]].tobytes())
                texts.append(b"".join(out).decode())
            gone = pa.array([bool(s) and t is None for s, t in zip(batch.column(starts).to_pylist(), texts, strict=True)])
            i = batch.schema.get_field_index("text")
            out = batch.set_column(i, "text", pa.array(texts, pa.string())).drop_columns([starts, ends])
            yield out.filter(pc.invert(gone))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """The documents without the words of contaminated spans; those with more than `coverage` of their words hit go."""
    key, starts, ends = jobs.free_names(docs, "_key", "_starts", "_ends")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    spans = contaminated_spans(keyed.select("doc_id", "text", F.col(key).alias("row_key")), benchmark, window).filter(F.size("starts") > 0)
    spans = spans.select(F.col("row_key").alias(key), F.col("starts").alias(starts), F.col("ends").alias(ends)).dropDuplicates([key])
    empty = F.array().cast("array<int>")
    both = keyed.join(spans.hint("merge"), key, "left").select(*docs.columns, *[F.coalesce(c, empty).alias(c) for c in (starts, ends)])
    return both.mapInArrow(jobs.tidy(_cut(coverage, starts, ends)), docs.schema)
