"""The operators for training data against brute force on small texts, with the odd cases."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from quantloom.llm import byte_bpe, components, decontaminate, jaccard_join, jobs, language_id, pii, substring_dedup, token_counts, token_files, url_filter, vector_dedup
from quantloom.llm.pretokens import Pretokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blob string"
ODD = [
    (90001, None), (90002, ""), (90003, " \t\n"), (90004, "one"), (90005, "it's 'll don't\n\n  x 日本語 😀 ½ <|endoftext|>"), (90005, "it's 'll don't\n\n  x 日本語 😀 ½ <|endoftext|>"),
    (90006, "a" * 3000), (90007, "w1 w2 w3"), (90008, "W1 w2 w3"), (None, "no id here at all"), (90009, "x" + " y z" * 3000),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    jobs.ship(spark)
    odd = spark.createDataFrame([(i, t, None, None, 0) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    rows = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd).withColumn("row_key", F.lit("clash")).withColumn("ids", F.lit(1))
    return jobs.stored(rows, "docs")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def empty(spark, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame([], schema)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def rows_of(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_pretokens():
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = np.random.default_rng(3)
    letters = list("ab1 '\n\t srtvelmd é中😀.½\u3000")
    cases = ["".join(rng.choice(letters, rng.integers(0, 25))) for _ in range(3000)]
    p = Pretokens(pa.array(cases))
    for i, t in enumerate(cases):
        assert [p.piece(j).decode() for j in range(p.rows[i], p.rows[i + 1])] == pattern.findall(t)


def test_byte_bpe(spark, docs, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, t in texts:
        ids = enc.encode_ordinary(t)
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())] += 1
    assert rows_of(byte_bpe.encode_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()
    assert collections.Counter((r.doc_id, r.decoded.decode()) for r in back) == collections.Counter(texts)
    assert byte_bpe.encode_digests(empty(spark), path).count() == 0


def test_decontaminate(spark, sf, docs, texts):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([(9001, "the and"), (9002, "of"), (9003, ""), (9004, None)], "item_id long, text string"))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for r in items.collect():
        w = words(r.text)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(str(r.item_id))
    want = collections.Counter()
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if k := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    found |= k
        want[i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)] += 1
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate.contamination(docs, items), *cols) == want
    assert rows_of(decontaminate.contamination(docs, empty(spark, "item_id long, text string")), "n_hit") == {(0,): len(texts)}
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(texts)
    assert {r.row_key for r in kept.select("row_key").distinct().collect()} == {"clash"}


def test_substring_dedup(spark, docs, texts):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts]
    first: dict = {}
    for i, w in split:
        if i is not None:
            for j in range(len(w) - 49):
                k = tuple(w[j : j + 50])
                first[k] = min(i, first.get(k, i))
    want = collections.Counter()
    for i, w in split:
        gone = {p for j in range(len(w) - 49) if i is not None and first[tuple(w[j : j + 50])] < i for p in range(j, j + 50)}
        want[i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode())] += 1
    assert rows_of(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
    # every factor is a stretch of its source, which is earlier
    keyed = docs.filter("doc_id is not null").select("doc_id", "text", F.monotonically_increasing_id().alias("row_key"))
    keyed = jobs.stored(keyed, "keyed")
    of = {r.row_key: (r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in keyed.collect()}
    texts_of = collections.defaultdict(list)
    for i, w in of.values():
        texts_of[i].append(" ".join(["", *w, ""]))
    n = 0
    for r in substring_dedup.duplicate_factors(keyed).collect():
        i, w = of[r.row_key]
        for first, windows, source in zip(r.first, r.windows, r.source, strict=True):
            assert source < i and any(" ".join(["", *w[first : first + windows + 49], ""]) in t for t in texts_of[source])
            n += 1
    assert n > 100


def test_substring_factors_of_chained_sources(spark):
    """A document made of pieces of several earlier ones, repeated words, and two texts under one doc_id."""
    rng = np.random.default_rng(8)
    word = lambda k: f"w{k}"
    base = [list(map(word, rng.integers(0, 5000, 400))) for _ in range(6)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    rows += [(10, " ".join(base[0][:120] + base[1][50:200] + base[2][300:])), (11, " ".join(["a"] * 300)), (12, " ".join(["a"] * 200)), (13, " ".join(base[3][10:59])), (13, " ".join(base[3][10:60])), (5, " ".join(base[4]))]
    rows += [(100 + k, " ".join(base[5][40:140])) for k in range(300)]
    docs = jobs.stored(spark.createDataFrame(rows, "doc_id long, text string"), "chained")
    first: dict = {}
    split = [(i, t.split()) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            first[k] = min(i, first.get(k, i))
    want = collections.Counter()
    for i, w in split:
        gone = {p for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for p in range(j, j + 50)}
        want[i, len(w), len(gone)] += 1
    assert rows_of(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed") == want


def jaccard_truth(rows, width=5, percent=80):
    """n_shingles and component of each row, by comparing all documents that share a shingle."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    at = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(min(p, q), max(p, q)) for g in at.values() for k, p in enumerate(g) for q in g[k + 1 :]}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard(spark, docs):
    extra = spark.createDataFrame([(5000 + k, " ".join(f"t{j}" for j in range(200)) + f" v{k} w{k}") for k in range(40)], "doc_id long, text string")
    both = jobs.stored(docs.select("doc_id", "text").filter("doc_id is not null").unionByName(extra), "both")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(both).collect()}
    assert got == jaccard_truth([(r.doc_id, r.text) for r in both.collect()])
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


@pytest.mark.parametrize(("tile", "sketch_tile"), [(512, 2048), (7, 11)])
def test_jaccard_stars(spark, tile, sketch_tile):
    """A large group of near-copies, some of which are linked only to each other, in one tile and in many."""
    rng = np.random.default_rng(5)
    base, rows = [f"b{j}" for j in range(240)], []
    for k in range(150):
        words, sub = list(base), k % 3
        for j in rng.choice(240, 4 if sub else 11, replace=False):
            words[j] = f"x{k}.{j}"
        if sub == 2:  # a family of its own, too far from the base
            words[100:112] = [f"f{k // 30}.{j}" for j in range(12)]
        rows.append((k, " ".join(words)))
    docs = jobs.stored(spark.createDataFrame(rows, "doc_id long, text string"), "stars")
    want = jaccard_truth(rows)
    assert 1 < len({c for _, c in want.values()}) < 150
    rows_, links = jaccard_join.jaccard_links(docs, tile=tile, sketch_tile=sketch_tile)
    label = components.components(links)
    got = rows_.join(label, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("c")).collect()
    assert {r.doc_id: (r.n_shingles, r.c) for r in got} == want


def test_jaccard_large_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 200_000)
    try:
        docs = spark.range(0, 140_000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c d"), F.col("id")).alias("text"))
        assert jaccard_join.jaccard_components(jobs.stored(docs, "short")).filter("n_shingles <> 1 or component_id <> doc_id").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_jaccard_repeated_ids(spark):
    """Two texts under one doc_id are linked by it; rows without one take the component of their set."""
    a, b = " ".join(f"a{j}" for j in range(30)), " ".join(f"b{j}" for j in range(30))
    docs = jobs.stored(spark.createDataFrame([(3, a), (3, b), (5, a), (7, b), (None, b), (9, None)], "doc_id long, text string"), "repeated")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == [(0, 3), (3, 3), (3, 3), (5, 3), (7, 3), (9, 9)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    got = dict(components.components(edges).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_url_rules(spark):
    urls = [None, "mailto:x", "HTTP://Ex.COM/en/7?x", "a://b://c/d", "http://EXAMPLE.net", "://x/y\nz#k", "http://www.example.net/de/8", "http://www.example.net/de/9", "http://notexample.com/en/7", "http://example.com/en/71"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = empty(spark, "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, labels).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("ex.com", "/en/7", "com/en/", "block")
    assert got[3] == ("b:", "//c/d", None, "allow") and got[4] == ("example.net", "", None, "allow") and got[5] == ("x", "/y\nz", None, "allow")
    assert got[6][2:] == ("example.net/de/8", "block") and got[7][2:] == ("net/de/", "allow")
    assert got[8][2:] == ("com/en/", "block") and got[9][2:] == ("example.com/en/7", "allow")


def test_url_templates(spark):
    rows = [(k, f"http://h.org/{'bad' if k % 2 else 'good'}/{k}", k % 2) for k in range(400)]
    pages = spark.createDataFrame([(a, b) for a, b, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows[:200]], "page_id long, bad int")
    got = {r.page_id: (r.template, r.verdict) for r in url_filter.url_verdicts(pages, labels).collect()}
    assert all(got[a] == (("/bad/*", "block") if c else ("/good/*", "allow")) for a, _, c in rows)


def test_url_merging(spark):
    """A small bad host is rejected as a whole, a bad section of a good host alone; empty tables, repeated and null rows, extra columns."""
    rows = [(k, f"http://bad.org/{'en' if k % 3 else 'de'}/{k}", 1) for k in range(30)]
    rows += [(100 + k, f"http://ok.org/{('a', 'b', 'spam')[k % 3]}/{'x' if k % 2 else 'y'}/{k}?q", int(k % 3 == 2)) for k in range(300)]
    rows += [(900, None, None), (901, "http://new.org/" + "/".join("abc" * 20), None), (None, "http://bad.org/en/77", None), (5, "http://bad.org/de/5", 1)]
    pages = spark.createDataFrame([(a, b, "x", 1, "y") for a, b, _ in rows], "page_id long, url string, template string, _s int, parent string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows if a is not None and c is not None], "page_id long, bad int")
    got = url_filter.url_verdicts(pages, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        bad = r.host == "bad.org" or r.host == "ok.org" and r.path.startswith("/spam")
        assert r.verdict == ("block" if bad else "allow"), r
    assert {r.branch for r in got if r.host == "bad.org"} == {""} and "/spam" in {r.branch for r in got if r.host == "ok.org"}
    assert url_filter.url_verdicts(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(pages, labels.limit(0)).collect()} == {"allow"}


def test_url_query_judges_by_branch(spark, tmp_path):
    """Pages are labelled by their own text: a junk section of a good host is rejected alone, a null page by its template."""
    from quantloom.llm import queries

    prose = "<html><nav>* # *</nav><!-- ### --><script>a = {b};</script><p>The words of <b>a page</b> that reads well.</p><style>p{x}"
    junk = "<html><body><p>" + "abc*** | de### fg " * 20 + "</p>"
    rows = [(k, f"http://h.org/{('news', 'blog', 'dump')[k % 3]}/{k}", None if k % 10 == 7 else junk if k % 3 == 2 or k % 20 == 0 else prose) for k in range(300)]
    rows += [(1000 + k, f"http://shop.net/{'casino' if k % 2 else 'books'}/{k}", prose) for k in range(200)]
    rows += [(2000, "http://h.org/dump/x", ""), (2001, None, None), (2002, "http://h.org/blog/y", "<p>1 2 3 4 5</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op4_url_filter(spark, str(tmp_path)).collect()}
    for k, url, _ in rows:
        assert got[k].verdict == ("block" if url and ("/dump/" in url or "/casino/" in url) else "allow"), got[k]
    assert {got[k].branch for k in range(2, 300, 3)} == {"/dump"} and {got[1001].branch, got[1000].branch} == {"/casino", "/books"}
    labels = {r.page_id: r.bad for r in url_filter.page_labels(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.BAD_WORDS).collect()}
    for k, url, html in rows:
        want = 1 if url and "casino" in url else None if not html else int(html != prose)
        assert labels[k] == want, (k, labels[k], want)


def test_token_files(spark, docs):
    path, tok = jobs.scratch(spark, "orc"), public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_token_files(docs, tok, path)
    lib, at = tokenizers.Tokenizer.from_file(tok), 0
    got = {r.doc_id: r for r in token_files.token_index(spark, path).collect()}
    for r in sorted(docs.filter("doc_id is not null").select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    total = sum(r.n_tokens for r in token_files.read_token_files(spark, path).collect())
    spans = sorted((r.start, r.n_tokens) for r in token_files.token_index(spark, path).collect())
    for start, n in spans:
        assert start == at
        at += n
    assert at == total
    assert token_files.read_token_files(spark, path, [90001]).first().ids == [0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, texts, name):
    tok, cache = public_tokenizers.path(name), jobs.scratch(spark, "cache")
    if name.endswith(".json"):
        lib = tokenizers.Tokenizer.from_file(tok)
        count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=tok)
        count = lambda t: len(lib.encode(t))
    few = docs.filter("doc_id < 40 or doc_id > 90000 or doc_id is null")
    want = collections.Counter((i, len(t.encode()), count(t)) for i, t in texts if i is None or i < 40 or i > 90000)
    assert rows_of(token_counts.token_counts(few, tok, cache), "doc_id", "n_bytes", "n_tokens") == want
    size = spark.read.parquet(cache).count()
    assert rows_of(token_counts.token_counts(few, tok, cache), "doc_id", "n_bytes", "n_tokens") == want
    assert spark.read.parquet(cache).count() == size == len({t for i, t in texts if i is None or i < 40 or i > 90000})


def test_personal_data(docs, texts):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, m):
        digits = re.sub("[^0-9]", "", m)
        total = sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(digits)))
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]

    odd = ["a@b.c_x@y.z", "é a.b@c-d.e.f, 😀 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "4111 1111 1111 1111 or 4111-1111-1111-1112 +1 (988) 555-2485", "\x01 +44 20 7946 0958x", "9" * 3000, "a." * 3000 + "@" + "b." * 3000]
    more = docs.sparkSession.createDataFrame([(95000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    both = jobs.stored(docs.select("doc_id", "text").unionByName(more), "pii-docs")
    want = collections.Counter()
    for i, t in texts + [(95000 + k, t) for k, t in enumerate(odd)]:
        spans = sorted((m.start(), list(patterns).index(k), f"{k}:{m.start()}:{m.end()}") for k in patterns for m in re.finditer(patterns[k], t) if passes(k, m[0]))
        n = collections.Counter(s[1] for s in spans)
        want[i, n[0], n[1], n[2], n[3], sha(",".join(s[2] for s in spans).encode())] += 1
    got = pii.personal_data(both)
    assert rows_of(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    text = {r.doc_id: r.text for r in pii.redact(more).collect()}
    assert text[95002] == "[card] or 4111-1111-1111-1112 [phone]"
    assert pii.personal_data(empty(docs.sparkSession)).count() == 0


def test_personal_data_beyond_the_base(spark):
    """Planted forms that no base pattern matches are found; documents without personal data get no span; names may clash."""
    rng = np.random.default_rng(2)
    words = lambda n: " ".join("".join(rng.choice(list("abdefghilmnorstu"), rng.integers(2, 9))) for _ in range(n))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    phone = lambda: f"({rng.integers(200, 990)}) 555-{digits(4)}"

    def card():
        body = "4" + digits(14)
        total = sum(int(c) if k % 2 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(body)))
        n = body + str(-total % 10)
        return " ".join(n[k : k + 4] for k in range(0, 16, 4))

    plain = {"email": lambda: f"{words(1)}.{words(1)}@{words(1)}.org", "ip": lambda: ".".join(map(str, rng.integers(1, 255, 4))), "card": card, "phone": lambda: f"+1 {phone()}"}
    other = {"email": lambda: f"{words(1)}.{words(1)} (at) {words(1)} (dot) org", "phone": lambda: f"call {phone()}", "card": lambda: card().replace(" ", ".")}
    rows, planted, clean = [], {}, set()
    for k in range(1200):
        if k % 4 == 0:
            kind = list(plain)[k // 4 % 4]
            rows.append((k, f"{words(8)} {plain[kind]()} {words(5)}"))
        elif k % 4 == 1:
            kind = list(other)[k // 4 % 3]
            planted[k] = kind
            rows.append((k, f"{words(8)} {other[kind]()} {words(5)}"))
        else:
            clean.add(k)
            noise = [f"id = {sha(digits(9).encode())}", f"page {digits(3)}, {digits(4)}", f"ref-{digits(5)}-{digits(3)}x", "version 1.2.3"][k // 4 % 4]
            rows.append((k, f"{words(9)} {noise} {words(4)}"))
    docs = jobs.stored(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_key": F.lit("mine"), "_spans": F.lit(3)}), "planted")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for kind in other:
        ids = [i for i, k in planted.items() if k == kind]
        assert np.mean([f"{kind}:" in got[i].spans for i in ids]) >= 0.8, kind
    assert all(got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == 0 for i in planted)
    assert sum(bool(got[i].spans) for i in clean) <= 0.01 * len(clean)
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns and redacted.filter("_key = 'mine' and _spans = 3").count() == len(rows)


def test_personal_data_learns_from_all_examples(spark):
    """No example is left out: base spans and their forms, and matches that fail, however many."""
    n = 6000
    rows = [(i, f"write to u{i}@mail.org now") for i in range(n)] + [(n + i, f"at 1.2.3.{300 + i} there") for i in range(n)]
    spans = pii.candidates(spark.createDataFrame(rows, "row_key long, text string"))
    got = pii.examples(spans)
    count = {(r.kind, r.label): r.n for r in got.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    assert count["email", 1.0] == 4 * n  # as it is and in three other forms
    assert count["ip", 0.0] >= 3 * n
    assert got.count() < n


def test_language(spark, sf, docs):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    models = language_id.fit(rows.filter(~language_id.held_out()))
    found = language_id.identify(rows.filter(language_id.held_out()), models).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found) and not any(r.rejected for r in found)
    odd = {r.doc_id: r for r in language_id.identify(docs.filter("doc_id > 90000").select("doc_id", "text"), models).collect()}
    assert odd[90001].lang_pred == odd[90002].lang_pred == "und" and odd[90001].score == 0 and odd[90001].rejected
    assert language_id.fit(empty(spark)) is None and language_id.identify(empty(spark), models).count() == language_id.known(empty(spark), None).count() == 0


def test_language_clashes_and_repeats(spark):
    """Columns with the results' names, a doc_id of two languages, and many rows of one doc_id."""
    rows = [(k % 40, f"{'the cat sat on the mat' if k % 2 else 'der hund lief durch den wald'} {k}", "en" if k % 2 else "de") for k in range(400)]
    rows += [(7, "der hund lief", "de")] * 50 + [(None, "the cat", "en"), (900, None, "en"), (901, "  12 ", "de")]
    docs = jobs.stored(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("mine"), "rejected": F.lit(7), "lang_pred": F.lit(1.5)}), "clash")
    models = language_id.fit(docs, 15, 5)
    assert models.languages == ["de", "en"]
    got = language_id.identify(docs, models)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "cross_entropy", "rejected"] and got.count() == len(rows)
    kept = language_id.known(docs, models)
    assert kept.columns == docs.columns and kept.filter("score = 'mine'").count() == kept.count() == got.filter("not rejected").count()
    assert kept.filter("doc_id in (900, 901)").count() == 0
    assert got.filter("lang_pred <> lang and not rejected").count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 32))
    v = np.concatenate([c + 0.12 * rng.normal(size=(30, 32)) for c in centre]).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(8000 + k, v[0].tolist()) for k in range(50)]
    odd = [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [None] * 32), (9005, [1.0, 2.0]), (9006, [2.0, 4.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    nodes, links = vector_dedup.vector_links(df, shard=200)
    truth, found = vector_dedup.audit(df, links, nodes)
    assert truth > 1000 and found >= 0.9 * truth
    got = {r.vec_id: r for r in vector_dedup.vector_components(df).collect()}
    assert [got[k].n_links for k in range(9001, 9007)] == [0, 0, 0, 0, 1, 1] and got[9006].component_id == 9005
    assert got[8003].component_id == 0 and got[8003].n_links >= 50 and not got[8003].kept and got[0].kept
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(float(u[a].astype(float) @ u[b].astype(float)) >= 0.9 - 1e-6 for a, b in links.collect() if max(a, b) < 8000)
    assert vector_dedup.vector_components(empty(spark, "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_one_large_group(spark):
    """Near-copies that k-means splits over many shards: no link between the shards is lost."""
    rng = np.random.default_rng(8)
    near = rng.normal(size=64) + 0.2 * rng.normal(size=(1500, 64))
    v = np.concatenate([near, rng.normal(size=(1500, 64))]).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    nodes, links = vector_dedup.vector_links(df, shard=60)
    truth, found = vector_dedup.audit(df, links, nodes)
    assert truth > 200_000 and found >= 0.999 * truth
    assert links.count() == links.distinct().count()


def test_url_sections_of_a_large_host(spark):
    """A bad section is rejected by its own pages, however large its host is and however deep it lies."""
    rows = [(k, f"http://h.org/s{k % 100}/{k}", int(k % 100 == 7)) for k in range(8000)]
    rows += [(9000 + k, f"http://deep.org/a/b/c/d/e/f/g/{'bad' if k % 2 else 'good'}/{k}", k % 2) for k in range(400)]
    pages = spark.createDataFrame([(a, b) for a, b, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows], "page_id long, bad int")
    got = {r.page_id: (r.template, r.verdict) for r in url_filter.url_verdicts(pages, labels).collect()}
    assert all(got[a][1] == ("block" if c else "allow") for a, _, c in rows)
    assert got[7][0] == "/s7/*" and got[9001][0] == "/a/b/c/d/e/f/g/bad/*"


def test_decontaminate_in_blocks(spark):
    """Repeated rows are all there, whatever the number of blocks."""
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(15))
    items = spark.createDataFrame([(k, words(k)) for k in range(4)], "item_id long, text string")
    texts = [(1, words(0) + " " + words(1)), (1, words(0) + " " + words(1)), (2, "clean"), (2, "clean"), (None, words(3)), (None, words(3)), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    whole = rows_of(decontaminate.contamination(docs, items), *cols)
    assert sum(whole.values()) == len(texts) and rows_of(decontaminate.contamination(docs, items, block_bytes=100), *cols) == whole
