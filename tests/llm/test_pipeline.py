"""The corpus pipeline: each stage against a plain loop over its own input, with the odd rows, and the whole of it."""

import base64
import collections
import re
import shutil
import tempfile

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import jobs, language_id, pii

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)
LONG = " ".join(f"word{k} again" for k in range(9000))
ODD = [
    (91001, None), (91002, ""), (91003, "12 !! 34"), (91004, "x"), (91005, "mail a.b@c.org or +49 30 1234567, call 192.168.0.1"), (91005, "mail a.b@c.org or +49 30 1234567, call 192.168.0.1"),
    (None, "a document without an id, that says something"), (91006, LONG), (91007, "the and " * 30), (91008, "日本語 😀 \n\n  text"),
]


@pytest.fixture(scope="module")
def folder(spark, sf):
    """The smallest tables, with odd rows among the documents, in a folder of their own."""
    jobs.ship(spark)
    path = tempfile.mkdtemp(prefix="tables-")
    shutil.copy(f"{sf}/benchmark.parquet", f"{path}/benchmark.parquet")
    odd = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in ODD], SCHEMA)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    leaks = spark.createDataFrame([(92001, f"some words before it. {item} and others that follow here, quite a few of them: {' '.join(f'tail{k}' for k in range(90))}", "en", "s", 0), (92002, item, "en", "s", 0)], SCHEMA)
    spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd).unionByName(leaks).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows(df):
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def test_every_stage_takes_odd_tables(spark, docs, folder):
    none = docs.limit(0)
    clash = docs.limit(30).withColumns({c: F.lit(1) for c in ("row_key", "component_id", "spans", "Score", "ids", "_key", "held_out")})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, folder)
        assert got.count() == 0, name
        if name != "encoded":
            assert got.columns == COLUMNS
            kept = stage(spark, clash, folder)
            assert kept.columns == clash.columns and kept.count() <= 30, name


def test_known_language(spark, docs, folder):
    got = rows(STAGE["known_language"](spark, docs, folder))
    models = language_id.fit(docs.filter(~language_id.held_out()))
    assert got == rows(language_id.identify(docs.select(*COLUMNS), models).filter("not rejected"))
    clean = rows(docs.filter("doc_id < 90000"))
    assert sum((got & clean).values()) >= 0.98 * sum(clean.values())
    assert not {91001, 91002, 91003} & {k[0] for k in got}


def test_near_duplicates(spark, docs, folder):
    """One document of each group that links at 80 of 100 shingles stays; those without words link with nothing."""
    got = rows(STAGE["near_duplicates"](spark, docs, folder))
    sets = {}
    for i, t in {(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None}:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    where = collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            where[s].append(i)
    shared = collections.Counter((a, b) for own in where.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            least[b] = a
    want = collections.Counter({k: n for k, n in rows(docs).items() if k[0] is None or find(k[0]) == k[0]})
    assert got == want and sum(got.values()) < docs.count()


def test_benchmark_passages(spark, docs, folder):
    """No item's window of ten words is left, clean documents are as they were, and a document that is mostly such passages goes."""
    got = STAGE["benchmark_passages"](spark, docs, folder)
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(len(w) - 9)} | {tuple(w) for w in items if 0 < len(w) < 10}
    short = {len(w) for w in windows}
    hit = lambda t: any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in short for k in range(len(w) - n + 1))
    after = rows(got)
    clean = collections.Counter({k: n for k, n in rows(docs).items() if not hit(k[1])})
    assert clean - after == collections.Counter()
    assert not any(hit(k[1]) for k in after)
    changed = {k[0]: k[1] for k in after - clean}
    assert 92001 in changed and "some words before it" in changed[92001] and "tail89" in changed[92001] and 92002 not in {k[0] for k in after}


def test_personal_data(spark, docs, folder):
    got = STAGE["personal_data"](spark, docs, folder)
    assert got.count() == docs.count() and collections.Counter(r.doc_id for r in got.collect()) == collections.Counter(r.doc_id for r in docs.collect())
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[91005] == "mail [email] or [phone], call [ip]" and texts[91001] is None and texts[91006] == LONG
    spans = pii.personal_data(docs.filter("doc_id < 90000")).filter("spans = ''").select("doc_id")
    before = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == before[r.doc_id] for r in spans.collect())


def test_the_whole(spark, docs, folder):
    """Each stage works on what the one before it kept; the last ids decode to the last texts."""
    kept, was = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = jobs.stored(stage(spark, kept, folder), name)
        assert kept.columns == COLUMNS and kept.count() <= was
        was = kept.count()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter((r.doc_id, tuple(enc.encode_ordinary(r.text or ""))) for r in kept.collect())
    got = corpus_pipeline.run(spark, folder)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    assert 0.5 * docs.count() < was < docs.count() and np.mean([i is not None and i < 90000 for i, _ in want]) > 0.9
