"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of `ORDER`-character grams over its lower-cased words, a blank marking both ends; contexts
don't cross words, so a document's cross-entropy is a sum over its distinct words.  Grams and contexts of all languages
stand in sorted arrays of 64-bit hashes, one column of log values a language.  The language of lowest cross-entropy a
character is chosen.  A document whose lowest cross-entropy exceeds what calibration documents showed is rejected; the
score is the calibrated softmax share of the chosen language.

The models are fitted on at most `SAMPLE_DOCS` labelled documents a language, calibrated on `CALIBRATION_DOCS` more, both
picked by a hash of doc_id: the fit is bounded, every text is judged whole.  What is broadcast is bounded by that and by
`MOST_LANGUAGES`; more are an error.

A null text, or one without letters, is `und` with score 0, and rejected; so is every text if nothing is labelled.
Ties go to the first language by name.  Repeated rows and rows without a doc_id are judged alike; of the rows of one
doc_id at most one is learned from, that of the smallest language and text.  A column of the documents that has the name
of one of the results is replaced; `known` returns the documents' own columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import jobs
from .pretokens import _byte_classes
from .textops import U64, hash_spans, mix64, runs, text_buffer

ORDER = 4
SAMPLE_DOCS, CALIBRATION_DOCS = 600, 200
#: Cross-entropy beyond the largest of the calibration documents', as a share of it, at which a text is rejected.
MARGIN = 0.25
UNKNOWN = "und"
#: Words that a worker keeps the scores of, and scores at once.
_CACHE_WORDS, _WORDS_AT_ONCE = 400_000, 8_000
#: Languages at most, and parts in which a language's documents are ranked first.
MOST_LANGUAGES, _PARTS = 512, 32
RESULTS = "lang_pred string, score double, cross_entropy double, rejected boolean"
#: Bytes of text split at once.
_SLICE = 1 << 20


def _letters(column: pa.Array):
    """Lower-cased words of letters: the buffer, the spans, and the word offsets of the rows."""
    raw, offsets = text_buffer(pc.utf8_lower(column))
    starts, ends = runs(_byte_classes(raw) == 1, offsets)
    return raw, starts, ends, np.searchsorted(starts, offsets)


def _grams(words: list[bytes]):
    """For every character of ' word ' after the first: its word, its place, and the hashes of the grams that end there.

    hashes[k - 1] is the gram of k characters, valid where place >= k - 1.
    """
    text = (b" " + b" ".join(words) + b" ").decode("utf-8")
    cp = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(U64)
    blank = cp == 0x20
    at = np.flatnonzero(blank)
    word = np.cumsum(blank) - 1
    place = np.arange(len(cp)) - at[word]
    # a closing blank belongs to the word before it
    inner = np.ones(len(cp), bool)
    inner[0] = False
    word, place = np.where(blank, word - 1, word), np.where(blank, np.append(0, np.diff(at))[word], place)
    hashes, total = [], np.zeros(len(cp), U64)
    with np.errstate(over="ignore"):
        power = U64(1)
        for k in range(ORDER):
            shifted = np.zeros(len(cp), U64)
            shifted[k:] = cp[: len(cp) - k] + U64(1)
            total = total + shifted * power
            power = power * U64(0x9E3779B97F4A7C15)
            hashes.append(mix64(total + U64(k + 1)))
    return word[inner], place[inner], [h[inner] for h in hashes], [np.append(U64(0), h[:-1])[inner] for h in hashes]


def _fit(words: list[bytes], counts: np.ndarray):
    """One language's grams and contexts: (hash, log p) and (hash, log back-off)."""
    word, place, grams, contexts = _grams(words)
    weight = counts[word].astype(np.float64)
    vocabulary = len(np.unique(grams[0]))
    lower: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    gram_out, context_out = [], []
    for k in range(1, ORDER + 1):
        here = place >= k - 1
        # raw counts for the longest grams and those that start a word, else distinct characters to the left
        raw = here & ((k == ORDER) | (place == k - 1))
        rest = here & ~raw
        key = [grams[k - 1][raw]]
        num = [weight[raw]]
        owner = [contexts[k - 2][raw] if k > 1 else np.zeros(int(raw.sum()), U64)]
        up = [grams[k - 2][raw] if k > 1 else np.zeros(int(raw.sum()), U64)]
        if rest.any():
            _, first = np.unique(grams[k][rest], return_index=True)
            index = np.flatnonzero(rest)[first]
            key.append(grams[k - 1][index]), num.append(np.ones(len(index)))
            owner.append(contexts[k - 2][index] if k > 1 else np.zeros(len(index), U64)), up.append(grams[k - 2][index] if k > 1 else np.zeros(len(index), U64))
        key, num, owner, up = (np.concatenate(x) for x in (key, num, owner, up))
        kinds, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=num)
        owner, up = owner[first], up[first]
        n1, n2 = int((count == 1).sum()), int((count == 2).sum())
        discount = n1 / (n1 + 2 * n2) if n1 else 0.5
        names, which = np.unique(owner, return_inverse=True)
        total, kinds_of = np.bincount(which, weights=count), np.bincount(which)
        back = discount * kinds_of / total
        if k == 1:
            below = np.full(len(kinds), 1.0 / (vocabulary + 1))
        else:
            low_keys, low_p = lower[k - 1]
            below = low_p[np.searchsorted(low_keys, up)]
        p = np.maximum(count - discount, 0) / total[which] + back[which] * below
        lower[k] = (kinds, p)
        gram_out.append((kinds, np.log(p)))
        context_out.append((mix64(names + U64(k)), np.log(back)))
    cat = lambda x: (np.concatenate([a for a, _ in x]), np.concatenate([b for _, b in x]))
    return cat(gram_out), cat(context_out), vocabulary


@dataclass
class Models:
    """Sorted hash arrays of all languages, and the calibration."""

    languages: list[str]
    gram: np.ndarray
    log_p: np.ndarray
    context: np.ndarray
    log_back: np.ndarray
    floor: np.ndarray
    sharpness: float = 20.0
    limit: float = np.inf

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word under each language, and its number of characters."""
        parts = [self._scores(words[a : a + _WORDS_AT_ONCE]) for a in range(0, len(words), _WORDS_AT_ONCE)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        word, place, grams, contexts = _grams(words)
        n, langs = len(word), len(self.languages)
        score, done = np.zeros((n, langs), np.float32), np.zeros((n, langs), bool)
        for k in range(ORDER, 0, -1):
            here = np.flatnonzero((place >= k - 1) & ~done.all(axis=1))
            i = np.minimum(np.searchsorted(self.gram, grams[k - 1][here]), len(self.gram) - 1)
            p = np.where((self.gram[i] == grams[k - 1][here])[:, None], self.log_p[i], np.nan)
            seen = ~np.isnan(p) & ~done[here]
            score[here] += np.where(seen, p, 0)
            done[here] |= seen
            c = mix64((contexts[k - 2][here] if k > 1 else np.zeros(len(here), U64)) + U64(k))
            j = np.minimum(np.searchsorted(self.context, c), len(self.context) - 1)
            back = np.where((self.context[j] == c)[:, None], self.log_back[j], 0)
            score[here] += np.where(done[here], 0, back)
        score += np.where(done, 0, self.floor)
        out = np.zeros((len(words), langs))
        for x in range(langs):
            out[:, x] = np.bincount(word, weights=score[:, x], minlength=len(words))
        return out, np.bincount(word, minlength=len(words))


class _Seen:
    """Scores of words that a worker has met."""

    def __init__(self, models: Models):
        self.models = models
        self._clear()

    def _clear(self):
        self.keys = np.zeros(0, U64)
        self.score, self.size = np.zeros((0, len(self.models.languages)), np.float32), np.zeros(0, np.int32)

    def lookup(self, keys: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) + len(keys) > _CACHE_WORDS:
            self._clear()
        i = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[i] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            score, size = self.models.word_scores([word(k) for k in np.flatnonzero(new).tolist()])
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys)
            self.keys, self.score, self.size = all_keys[order], np.concatenate([self.score, score.astype(np.float32)])[order], np.concatenate([self.size, size.astype(np.int32)])[order]
            i = np.searchsorted(self.keys, keys)
        return self.score[i], self.size[i]


def _entropies(batch: pa.RecordBatch, seen: _Seen) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy a character of each row under each language, and its number of characters (0: no letters)."""
    raw, starts, ends, rows = _letters(batch.column("text"))
    kinds, first, codes = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
    langs = len(seen.models.languages)
    if not len(kinds):
        return np.full((batch.num_rows, langs), np.inf), np.zeros(batch.num_rows, np.int64)
    score, size = seen.lookup(kinds, lambda k: raw[starts[first[k]] : ends[first[k]]].tobytes())
    chars = np.diff(np.append(0, np.cumsum(size[codes], dtype=np.int64))[rows])
    total = np.stack([np.diff(np.append(0, np.cumsum(score[codes, x], dtype=np.float64))[rows]) for x in range(langs)], 1)
    return np.where(chars[:, None] > 0, -total / np.maximum(chars, 1)[:, None], np.inf), chars


def _lang_words(batches):
    """Distinct words of each batch by language, with counts."""
    for batch in jobs.slices(batches, most=_SLICE):
        raw, starts, ends, rows = _letters(batch.column("text"))
        if not len(starts):
            continue
        lang = np.array(batch.column("lang").to_pylist())
        row = np.repeat(np.arange(batch.num_rows), np.diff(rows))
        names, which = np.unique(lang, return_inverse=True)
        with np.errstate(over="ignore"):
            key = hash_spans(raw, starts, ends) + mix64(which.astype(U64))[row]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([jobs.binaries([x.encode() for x in names[which[row[first]]].tolist()], pa.string()), jobs.binaries([raw[starts[i] : ends[i]].tobytes() for i in first.tolist()]), pa.array(count)], ["lang", "word", "n"])


def _fit_language(table: pa.Table) -> pa.Table:
    words = table.column("word").to_pylist()
    (g, p), (c, b), vocabulary = _fit(words, np.asarray(table.column("n")))
    key = np.concatenate([g, c, np.zeros(1, U64)]).view(np.int64)
    kind = np.repeat(np.array([0, 1, 2], np.int32), [len(g), len(c), 1])
    value = np.concatenate([p, b, [-np.log(vocabulary + 1)]])
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(key)), "kind": kind, "key": key, "value": value})


def _union(rows: pa.Table, languages: list[str], kind: int, empty: float) -> tuple[np.ndarray, np.ndarray]:
    part = rows.filter(pc.equal(rows.column("kind"), kind))
    key = np.asarray(part.column("key")).view(U64)
    column = np.asarray(pc.index_in(part.column("lang"), pa.array(languages)))
    keys, at = np.unique(key, return_inverse=True)
    out = np.full((len(keys), len(languages)), empty, np.float32)
    out[at, column] = np.asarray(part.column("value"))
    return keys, out


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Models | None:
    """Models of the languages in `labelled` (doc_id, text, lang), from a bounded sample; None without any."""
    spark = labelled.sparkSession
    labelled = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    most = sample_docs + calibration_docs
    order = (F.xxhash64("doc_id"), "doc_id")
    # ranked in parts first, so that a language's ids don't meet in one task; one doc_id has one rank
    ids = labelled.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(_PARTS)).alias("part"))
    ids = ids.withColumn("rank", F.dense_rank().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= most).select("doc_id", "lang").distinct()
    picked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    # the picked ids are bounded by the parameters and the number of languages, which is checked
    languages = labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    texts = labelled.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id").agg(F.min(F.struct("lang", "text", "rank")).alias("row")).select("doc_id", "row.*")
    texts = jobs.stored(texts, "language-sample")
    counted = texts.filter(F.col("rank") <= sample_docs).select("lang", "text").mapInArrow(jobs.tidy(_lang_words), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("lang").applyInArrow(_fit_language, "lang string, kind int, key long, value double").toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    if not languages:
        return None
    gram, log_p = _union(rows, languages, 0, np.nan)
    context, log_back = _union(rows, languages, 1, 0.0)
    _, floor = _union(rows, languages, 2, 0.0)
    models = Models(languages, gram, log_p, context, log_back, floor[0])
    shared = spark.sparkContext.broadcast(models)

    def entropies(batches):
        seen = _Seen(shared.value)
        for batch in jobs.slices(batches, most=_SLICE):
            e, n = _entropies(batch, seen)
            ok = n > 0
            yield pa.RecordBatch.from_arrays([batch.column("lang").filter(pa.array(ok)), pa.array(list(e[ok]), pa.list_(pa.float64()))], ["lang", "e"])

    held = texts.filter(F.col("rank") > sample_docs).select("lang", "text").mapInArrow(jobs.tidy(entropies), "lang string, e array<double>").toArrow()
    if not held.num_rows:  # few documents: calibrate on those that were counted
        held = texts.select("lang", "text").mapInArrow(jobs.tidy(entropies), "lang string, e array<double>").toArrow()
    if held.num_rows:
        e = np.array(held.column("e").to_pylist())
        truth = np.array([languages.index(x) if x in languages else 0 for x in held.column("lang").to_pylist()])
        models.limit = float(e.min(axis=1).max() * (1 + MARGIN))
        losses = {}
        for s in 2.0 ** np.arange(0, 8):
            z = -s * (e - e.min(axis=1, keepdims=True))
            losses[s] = -np.mean(z[np.arange(len(e)), truth] - np.log(np.exp(z).sum(axis=1)))
        models.sharpness = float(min(losses, key=losses.get))
    return models


def _predict(shared, only_known: bool = False):
    clash = {c.split()[0] for c in RESULTS.split(", ")}

    def run(batches):  # result names replace columns of the same name in any case
        models = shared.value
        seen = models.__dict__.setdefault("_words", _Seen(models))  # kept while the worker holds the broadcast
        names = [x.encode() for x in (*models.languages, UNKNOWN)]
        for batch in jobs.slices(batches, most=_SLICE):
            e, n = _entropies(batch, seen)
            best = np.where(n > 0, e.argmin(axis=1), len(models.languages))
            low = np.where(n > 0, e.min(axis=1), 0)
            rejected = (n == 0) | (low > models.limit)
            if only_known:
                yield batch.filter(pa.array(~rejected))
                continue
            z = np.exp(-models.sharpness * (np.where(n[:, None] > 0, e, 0) - low[:, None]))
            # beyond the limit the text is likely of no learned language, whichever of them is nearest
            score = np.where(n > 0, np.exp(-models.sharpness * np.maximum(low - models.limit, 0)) / z.sum(axis=1), 0.0)
            cols = [jobs.binaries([names[k] for k in best.tolist()], pa.string()), pa.array(score), pa.array(low), pa.array(rejected)]
            kept = [k for k, c in enumerate(batch.schema.names) if c.lower() not in clash]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *cols], [*(batch.schema.names[k] for k in kept), "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """The rows of docs with lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected."""
    if models is None:
        taken = [f.split()[0] for f in RESULTS.split(", ")]
        docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "cross_entropy": F.lit(0.0), "rejected": F.lit(True)})
    results = StructType.fromDDL(RESULTS)
    schema = StructType([*(f for f in docs.schema if f.name.lower() not in results.names), *results])
    return docs.mapInArrow(jobs.tidy(_predict(docs.sparkSession.sparkContext.broadcast(models))), schema)


def known(docs: DataFrame, models: Models | None) -> DataFrame:
    """The rows of docs that are not rejected, with their own columns; without models, those with a letter."""
    if models is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return docs.mapInArrow(jobs.tidy(_predict(docs.sparkSession.sparkContext.broadcast(models), True)), docs.schema)


def held_out():
    """True for the rows that nothing is learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
