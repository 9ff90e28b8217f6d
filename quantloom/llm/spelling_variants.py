"""Spelling variants of a corpus's words by reduced alphabets.

Letters are hashed to a few symbols, so that words become reduced words; words one edit apart have reduced words that are
the same or one edit apart.  Every reduced word's one-edit neighbourhood is generated and joined with the reduced
vocabulary, and the words behind a met pair are verified on their original strings.  The neighbourhoods of two reduced
words hold each other, so each pair is generated from one side: a deletion from the longer word (an insertion is that,
seen from the other), a replacement from the word with the smaller symbol.

Neighbours are 64-bit polynomial hashes, found from prefix sums in time linear in a word's length and the symbols, however
long the word is; a collision only adds a candidate.  A reduced word that stands for more than `MOST_WORDS` words would
pair them all: those words take the letters themselves as symbols, and their neighbourhoods meet the whole vocabulary,
so that a word has a bounded number of candidates whatever the corpus, and no pair is left out.

Null and empty texts have no words; a null doc_id counts as an empty string in the hash that plants edits.  Repeated rows
count each time.  Other columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs
from .textops import U64, hash_spans, lower_ascii, mix64, runs, text_buffer

#: Symbols that letters are hashed to; words of one reduced word before its words are taken by their letters.
SYMBOLS, MOST_WORDS = 8, 256
#: Bytes of reduced words whose neighbours a task makes at once, with all and with few symbols.
STEP_BYTES, FULL_STEP_BYTES = 1 << 17, 1 << 13
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Fixed values of the word contract: A to Z and a to z, and U+00C0 to U+00FF; only A to Z are lowered.
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
#: Longer words are hashed one by one.
_VECTORISED = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def span_crc32(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span's bytes, going on from the crc32 of what comes before it."""
    table = _crc_table()
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, longest = starts[order], int(length.max(initial=0))
    crc = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    left = np.searchsorted(-length[order], -np.arange(min(longest, _VECTORISED)), side="left")
    for k, m in enumerate(left.tolist()):
        part = crc[:m]
        crc[:m] = table[(part ^ raw[at[:m] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > _VECTORISED).tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def _taken(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans' bytes as strings."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw[index].tobytes())])


def _words(shortest: int, every: int):
    def run(batches):
        for batch in jobs.slices(batches):
            raw, offsets = text_buffer(batch.column("text"))
            raw = lower_ascii(raw)
            mask = ((raw >= 0x61) & (raw <= 0x7A)) | (raw == 0xC3)  # the letters from U+00C0 are those of lead byte C3
            mask[1:] |= raw[:-1] == 0xC3
            starts, ends = runs(mask, offsets)
            if not len(starts):
                continue
            row = np.searchsorted(offsets, starts, side="right") - 1
            heads = np.fromiter((zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()), np.uint32, batch.num_rows)
            crc = span_crc32(raw, starts, ends, heads[row]) if every else np.ones(len(starts), np.uint32)
            edited = crc % np.uint32(every or 2) == 0
            changed = []
            for s, e, h in zip(starts[edited].tolist(), ends[edited].tolist(), crc[edited].tolist(), strict=True):
                word = raw[s:e].tobytes().decode()
                k = h % len(word)
                if len(word) > shortest:
                    changed.append((word[:k] + word[k + 1 :]).encode())
            inner = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((raw & 0xC0) == 0x80, out=inner[1:])
            kept = ~edited & (ends - starts - inner[ends] + inner[starts] >= shortest)
            starts, ends = starts[kept], ends[kept]
            _, first, n = np.unique(hash_spans(raw, starts, ends), return_index=True, return_counts=True)
            plain = _taken(raw, starts[first], ends[first])
            words = pa.concat_arrays([plain, jobs.binaries(changed, pa.string())])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, np.ones(len(changed), np.int64)))], ["word", "n"])

    return run


def word_counts(docs: DataFrame, shortest: int = 5, every: int = 0) -> DataFrame:
    """(word, n): the runs of letters of at least `shortest` code points, and how often they occur.

    docs: doc_id, text.  With `every`, a run loses one code point before it is counted where `every` divides the crc32 h of
    `<doc_id>:<run>`: the one at h modulo its length.
    """
    found = docs.select("doc_id", "text").mapInArrow(jobs.tidy(_words(shortest, every)), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _reduced(letters: int):
    """The word with its letters replaced by symbols; with as many symbols as letters, each letter has its own."""
    if letters >= len(LETTERS):
        to = "".join(chr(0x21 + i) for i in range(len(LETTERS)))
    else:
        to = "".join(chr(0x21 + zlib.crc32(x.encode()) % letters) for x in LETTERS)
    return F.translate("word", LETTERS, to)


def _hashed(symbols: np.ndarray, offsets: np.ndarray):
    """Row, power and terms of every symbol, sums of terms before it in its row, and the rows' hashes."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    powers = np.full(int(size.max(initial=0)) + 2, _BASE, U64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    power = powers[np.arange(len(symbols)) - offsets[:-1][row]]
    sums = np.zeros(len(symbols) + 1, U64)
    np.cumsum((symbols.astype(U64) + U64(1)) * power, out=sums[1:])
    total = sums[offsets[1:]] - sums[offsets[:-1]]
    return row, power, sums[:-1] - sums[offsets[:-1]][row], sums[1:] - sums[offsets[:-1]][row], total, powers[size]


def _neighbours(letters: int, full: bool):
    """(a, b): a reduced word's hash, and the hashes of its neighbours; without `full` one of a pair has the other."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in jobs.slices(batches, "reduced", FULL_STEP_BYTES if full else STEP_BYTES):
                raw, offsets = text_buffer(batch.column("reduced"))
                symbols = raw.astype(np.int64) - 0x21
                row, power, before, upto, total, after = _hashed(symbols, offsets)
                first = np.append(True, (symbols[1:] != symbols[:-1]) | (row[1:] != row[:-1]))[: len(row)]  # equal symbols in a row: one deletion
                rows, keys = [row[first]], [(before + (total[row] - upto) * U64(_INVERSE))[first]]
                for step in range(1, letters):
                    up = symbols + step < letters
                    rows.append(row[up])
                    keys.append(total[row[up]] + U64(step) * power[up])
                    if full:
                        down = symbols >= step
                        rows.append(row[down])
                        keys.append(total[row[down]] - U64(step) * power[down])
                if full:
                    every = np.arange(len(total))
                    for s in range(1, letters + 1):
                        rows += [row, every]
                        keys += [before + U64(s) * power + (total[row] - before) * U64(_BASE), total + U64(s) * after]
                a, b = mix64(total), mix64(np.concatenate(keys))
                pairs = [pa.array(x.view(np.int64)) for x in (a[np.concatenate(rows)], b)]
                yield pa.RecordBatch.from_arrays(pairs, ["a", "b"])

    return run


def _keys(batches):
    for batch in jobs.slices(batches, "reduced", STEP_BYTES):
        raw, offsets = text_buffer(batch.column("reduced"))
        with np.errstate(over="ignore"):
            total = _hashed(raw.astype(np.int64) - 0x21, offsets)[4]
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), batch.column("reduced"), pa.array(mix64(total).view(np.int64))], ["word", "n", "reduced", "key"])


def _keyed(words: DataFrame, letters: int, name: str) -> DataFrame:
    return jobs.stored(words.select("word", "n", _reduced(letters).alias("reduced")).mapInArrow(jobs.tidy(_keys), "word string, n long, reduced string, key long"), name)


def _met(near: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of words (word, n, other, other_n) behind pairs of keys (a, b), verified on the words themselves."""
    one = left.select(F.col("key").alias("a"), "word", "n")
    two = right.select(F.col("key").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return near.join(one, "a").join(two, "b").filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def near_words(words: DataFrame, symbols: int = SYMBOLS, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, n, other, other_n): every word of (word, n) with each word exactly one inserted, deleted or replaced code point away."""
    keyed = _keyed(words, symbols, "reduced-words")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m"))
    over = jobs.stored(sizes.filter(F.col("m") > most_words).select("key"), "over-full")
    hot = over.limit(1).count() > 0
    usual = keyed.join(over, "key", "left_anti") if hot else keyed
    keys = usual.select("key", "reduced").distinct()
    steps = keys.select("reduced").mapInArrow(jobs.tidy(_neighbours(symbols, False)), "a long, b long")
    near = steps.join(keys.select(F.col("key").alias("b")).distinct(), "b").select("a", "b").distinct()
    within = usual.select("key", "word", "n")
    same = within.join(within.select("key", F.col("word").alias("other"), F.col("n").alias("other_n")), "key").filter("word < other").filter(F.levenshtein("word", "other", 1) == 1).drop("key")
    pairs = _met(near, usual, usual).unionByName(same)
    if hot:
        letters = _keyed(words, len(LETTERS), "lettered-words")
        full = letters.join(keyed.join(over, "key", "left_semi").select("word"), "word", "left_semi")
        steps = full.select("reduced").mapInArrow(jobs.tidy(_neighbours(len(LETTERS), True)), "a long, b long")
        near = steps.join(letters.select(F.col("key").alias("b")), "b").distinct()
        pairs = pairs.unionByName(_met(near, full, letters))
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.unionByName(back).distinct() if hot else pairs.unionByName(back)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that is reached from each word by following (word, form); forms must not go round.

    Each round follows twice as many forms as the one before; rounds are written to the shared folder.
    """
    at = jobs.stored(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = jobs.stored(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return at


def variants(words: DataFrame, ratio: int = 2, symbols: int = SYMBOLS, most_words: int = MOST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    form: the near word of largest n, of the smallest in code-point order, if it occurs at least `ratio` times as often;
    root: the last of the forms that follow from the word, the word itself if it has none.
    """
    if ratio < 2:
        raise ValueError("forms of a ratio below 2 could go round")
    words = jobs.stored(words.select("word", "n"), "vocabulary")
    best = near_words(words, symbols, most_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other"))).alias("best"))
    taken = -F.col("best.rank") >= ratio * F.col("n")
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.rank")).alias("form_n"))
    judged = jobs.stored(judged, "forms")
    return judged.join(roots(judged), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
