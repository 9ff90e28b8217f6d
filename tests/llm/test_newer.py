"""Quality scores, spelling variants and vector codes against plain loops, with the odd cases."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import jobs, language_id, quality_conv, queries, spelling_variants, substring_dedup, vector_codes, vector_dedup
from quantloom.plans.registry import TABLES

LETTER = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    jobs.ship(spark)


def by_sql(sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    return collections.Counter(tuple(v for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_vector_codes"])
def test_equal_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    assert collections.Counter(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == by_sql(sf, name)


def plain_counts(rows, shortest, every):
    out = collections.Counter()
    for i, t in rows:
        for w in LETTER.findall(t or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= shortest:
                out[w] += 1
    return out


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


WORDY = [
    (1, "Straße straße strasse Àéîõü àéîõü ÀÉ élève eleve éleve"), (2, None), (3, ""), (4, "  123 !! 中文 "), (None, "without an identifier without"), (5, "x" * 200 + " " + "x" * 199 + "y " + "x" * 201),
    (5, "x" * 200 + " " + "x" * 199 + "y " + "x" * 201), (6, "colour color colours kolour colour×colour"), (6, "colour color colours kolour colour×colour"), (7, "ÿÿÿÿÿ ÿÿÿÿÀ aaaaa aaaa aaaab baaaa"),
]


@pytest.mark.parametrize("every", [0, 3, 97])
def test_word_counts(spark, every):
    rng = np.random.default_rng(every)
    rows = WORDY + [(int(i), " ".join("".join(rng.choice(list("abÉé"), rng.integers(1, 8))) for _ in range(40))) for i in range(60)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, n int, word int")
    got = {r.word: r.n for r in spelling_variants.word_counts(df, 2, every).collect()}
    assert got == dict(plain_counts(rows, 2, every))


@pytest.mark.parametrize(("symbols", "most"), [(8, 256), (2, 10**9), (2, 3), (1, 1), (64, 256)])
def test_variants(spark, symbols, most):
    rng = np.random.default_rng(symbols)
    words = {"".join(rng.choice(list("abcàé"), rng.integers(1, 6))) for _ in range(250)} | {"ÿ" * 70, "ÿ" * 69, "ÿ" * 69 + "a", "colour", "color", "a" * 3000, "a" * 2999}
    counts = {w: int(rng.integers(1, 40)) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling_variants.variants(df, symbols=symbols, most_words=most).collect()
    assert len(got) == len(counts)
    assert {tuple(r) for r in got} == plain_variants(counts)


def test_long_chains_and_empties(spark):
    words = [("b" * k + "a" * (12 - k), 2**k) for k in range(13)]
    got = {r.word: r for r in spelling_variants.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {r.root for r in got.values()} == {"b" * 12} and got["b" * 12].form is None
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants.variants(spelling_variants.word_counts(none, 5, 97)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants.variants(spark.createDataFrame(words, "word string, n long"), ratio=1)


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = collections.Counter(len(v) for _, v, _ in kept if v and len(v) % parts == 0)
    size = min((-n, s) for s, n in sizes.items())[1] if sizes else 0
    fit = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in kept if len(v) == size and size and all(abs(x) <= 2**15 for x in v)]
    fit.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = size // parts
    books = [[tuple(v[p * w : p * w + w]) for _, v, _ in fit[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        got = [[nearest(p, v[p * w : p * w + w])[1] for _, v, _ in fit] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p * w : p * w + w] for (_, v, _), c in zip(fit, got[p], strict=True) if c == k]
                if own:
                    books[p][k] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    out = []
    for i, v, y in fit:
        best = [nearest(p, v[p * w : p * w + w]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), y))
    sums = collections.Counter()
    for _, _, e, y in out:
        sums[y] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((i, c, e, sums[y], digest) for i, c, e, y in out), len(kept) - len(fit)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_vector_codes(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 32).round(int(rng.integers(0, 3)))], int(i) % 3) for i in range(200)]
    rows += [(7, rows[7][1], None), (7, [-x for x in rows[7][1]], None), (None, rows[9][1], 1), (300, None, 1), (301, [None] * 32, 1), (302, [float("nan")] * 32, 1), (303, [float("inf")] + [0.0] * 31, 1), (304, [1.0] * 16, 1), (305, [], 1), (306, [1.0] * 31, 1), (307, [1e9] * 32, 9)]
    rows += [(400 + i, [float(np.float32(x)) for x in rng.normal(0, 9, 32)], None) for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, Error int")
    want, uncoded = plain_codes(rows)
    got = vector_codes.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert collections.Counter(map(tuple, (r for r in got if r.code is not None))) == want
    assert sum(r.code is None and r.error is None for r in got) == uncoded == 4
    assert {r.label_error for r in got if r.vec_id == 307} == {None}


def test_cells_are_exact_and_bounded():
    rng = np.random.default_rng(1)
    entries = rng.integers(-300, 300, (64, 4))
    entries[7] = entries[3]  # a tie
    part = rng.integers(-600, 600, (5000, 4))
    cells = vector_codes.Cells(entries, most=50)
    for some in np.array_split(part, 7):
        code, error = cells(some)
        distance = ((some[:, None, :] - entries) ** 2).sum(2)
        assert (code == distance.argmin(1)).all() and (error == distance.min(1)).all()
        assert len(cells.memo) <= 50
    left = vector_codes.Cells(entries).left_over(part[:200] >> 5 << 5)
    assert np.mean([len(x) for x in left]) < 32  # most entries are dominated


def test_vector_codes_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.vector_codes(none).count() == 0
    few = spark.createDataFrame([(1, None, 1), (2, [1.0] * 3, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in vector_codes.vector_codes(few).select("vec_id", "code", "error", "label_error").collect()] == [(2, None, None, None)]


@pytest.fixture(scope="module")
def judged(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = spark.createDataFrame([(70001, None), (70002, ""), (70003, "x"), (None, "The word and the word."), (70004, "y" * 300000), (70004, "y" * 300000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd).withColumn("Score", F.lit("clash")).withColumn("predicted", F.lit(7))
    return docs, labels, quality_conv.fit(docs, labels)


def test_quality_held_out(judged):
    docs, labels, net = judged
    got = quality_conv.quality(docs, net)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert got.filter("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0
    assert got.filter("doc_id is null and held_out").count() == 0
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    right = np.mean([r.predicted == r.quality for r in rows])
    kept = np.mean([r.predicted for r in rows if r.quality == 1])
    assert len(rows) > 500 and right > 0.97 and kept > 0.985


def test_quality_reads_whole_texts(judged):
    net = judged[2]
    clean = b"and the word was not there, or so they said. " * 4000
    junk = clean[:150_001] + b" thing*** of%%% are!! was### not$$$ the&&& " + clean[150_001:]
    score = quality_conv.scores(net, *quality_conv._buffer([clean, junk]))
    assert score[1] < score[0]


def test_pooled_equals_loop():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 7, 8, 1023, 1024, 1025, 5000, 40000)] + [b"abcdabcdabcdabcd", b"\0" * 20]
    net = quality_conv.train(texts[:8], [0, 1] * 4, 0.5)
    best, where = quality_conv.pooled(net, *quality_conv._buffer(texts), where=True)
    again, _ = quality_conv.pooled(net, *quality_conv._buffer(texts))
    assert np.allclose(best, again, atol=1e-4)
    for k, t in enumerate(texts):
        b = np.frombuffer(t + b"\0" * quality_conv.WIDTH, np.uint8)
        rep = quality_conv.repeated(b)
        x = np.concatenate([net.vectors[b], rep[:, None]], 1)
        want = max((x[i : i + quality_conv.WIDTH].ravel() @ net.filters for i in range(max(len(t), 1))), key=lambda v: v[0])[0] + net.bias[0]
        assert abs(want - best[k, 0]) < 1e-3
    eight = [any(i >= lag and (t := texts[9] + b"\0" * 8)[i : i + 8] == t[i - lag : i - lag + 8] for lag in quality_conv.LAGS) for i in range(16)]
    assert [bool(v) for v in quality_conv.repeated(np.frombuffer(texts[9] + b"\0" * 8, np.uint8))[:16]] == eight


def test_quality_without_labels(spark, judged):
    docs = judged[0].limit(5)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_conv.quality(docs, quality_conv.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert {r.score for r in quality_conv.quality(docs, quality_conv.fit(docs, one)).collect()} == {1.0}
    assert quality_conv.quality(docs.filter("doc_id = -1"), quality_conv.fit(docs, none)).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, " ".join(f"w{k}" for k in range(60)))], [(i, " ".join(f"w{i}-{k}" for k in range(60))) for i in range(20)]])
def test_substring_dedup_without_duplicates(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.substring_dedup(df).collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(60, 0)] * len(rows)


def test_substring_dedup_with_many_partitions(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        got = queries.QUERIES["op3_substring_dedup"](spark, sf)
        assert collections.Counter(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == by_sql(sf, "op3_substring_dedup")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_components_by_brute_force(spark, kind):
    """n_links and component_id of every row, in either precision, with copies and an id of two vectors."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(25, 24))
    v = np.concatenate([c + 0.1 * rng.normal(size=(rng.integers(1, 14), 24)) for c in centre])
    v = v.astype(np.float32).astype(float) if kind == "float" else v
    rows = [(k + 10, x.tolist()) for k, x in enumerate(v)] + [(3, v[40].tolist()), (3, v[40].tolist()), (5, v[0].tolist()), (5, v[-1].tolist()), (7, [0.0] * 24), (8, None)]
    got = collections.Counter(tuple(r) for r in vector_dedup.vector_components(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect())
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] or [0.0] * 24 for r in rows])
    size = np.linalg.norm(x, axis=1)
    unit = x / np.where(size > 0, size, 1)[:, None]
    near = (unit @ unit.T >= 0.9) & (size > 0)[:, None] & (size > 0)
    want = collections.Counter()
    label = np.where(size > 0, np.arange(len(rows)), -1)
    for _ in range(len(rows)):  # the smallest row number in reach
        label = np.where(size > 0, [label[n].min(initial=len(rows)) for n in near], -1)
    for k, (i, _) in enumerate(rows):
        c = int(ids[label == label[k]].min()) if size[k] > 0 else i
        want[i, len({j for j in ids[near[k]].tolist() if j != i}), c, i == c] += 1
    assert got == want


def test_language_names_in_any_case(spark):
    rows = [(k, f"{'the cat sat on the mat' if k % 2 else 'der hund lief durch den wald'} {k}", "en" if k % 2 else "de") for k in range(80)]
    docs = jobs.stored(spark.createDataFrame(rows + [(900, "съешь ещё этих мягких французских булок", "xx")], "doc_id long, text string, lang string").withColumns({"Score": F.lit("mine"), "REJECTED": F.lit(7)}), "cases")
    models = language_id.fit(docs.filter("lang <> 'xx'"), 15, 5)
    got = language_id.identify(docs, models)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "cross_entropy", "rejected"]
    scores = {r.doc_id: (r.score, r.rejected) for r in got.select("doc_id", "score", "rejected").collect()}
    assert scores[900][1] and scores[900][0] < 0.1 < min(s for i, (s, _) in scores.items() if i < 80)
    assert language_id.known(docs, models).columns == docs.columns
    assert language_id.identify(docs, None).columns == got.columns
    none = spark.createDataFrame([(1, "letters"), (2, "12 !"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in language_id.known(none, None).collect()] == [1]
