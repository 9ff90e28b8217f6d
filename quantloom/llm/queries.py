"""The queries of the numbered operators, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, jaccard_join, jobs, language_id, pii, quality_conv, spelling_variants, substring_dedup, token_counts, token_files, url_filter, vector_codes, vector_dedup

#: Where the public tokenizers' files are.
tokenizer_path = public_tokenizers.path


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    return byte_bpe.encode_digests(jobs.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    return decontaminate.contamination(jobs.table(spark, sf_dir, "documents"), jobs.table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    return substring_dedup.substring_dedup(jobs.table(spark, sf_dir, "documents"), texts=False)


#: Words in a url that label its page bad.
BAD_WORDS = ("casino", "bets", "pills", "spam", "ads-track")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled bad if its text is junk or a word of its url speaks for it; templates are judged by those labels."""
    jobs.ship(spark)
    pages = jobs.table(spark, sf_dir, "pages")
    return url_filter.url_verdicts(pages.select("page_id", "url"), url_filter.page_labels(pages, BAD_WORDS))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    path = jobs.scratch(spark, "token-files")
    token_files.write_token_files(jobs.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), path)
    return token_files.token_index(spark, path)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    return pii.personal_data(jobs.table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    docs = jobs.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", language_id.held_out().alias("held_out"), "text"), models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    counts = token_counts.token_counts(jobs.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), jobs.scratch(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    return jaccard_join.jaccard_components(jobs.table(spark, sf_dir, "documents"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    return vector_dedup.vector_components(jobs.table(spark, sf_dir, "embeddings"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    docs = jobs.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_conv.quality(docs, quality_conv.fit(docs, jobs.table(spark, sf_dir, "labels")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    counts = spelling_variants.word_counts(jobs.table(spark, sf_dir, "documents"), shortest=5, every=97)
    return spelling_variants.variants(counts.filter("n >= 3"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs.ship(spark)
    coded = vector_codes.vector_codes(jobs.table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_decontaminate, op3_substring_dedup, op4_url_filter, op5_token_files, op6_personal_data, op7_language_id, op8_token_counts, op9_jaccard_join,
        op10_vector_dedup, op11_quality, op12_spelling_variants, op13_vector_codes,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _codes_sql() -> str:
    """The rounds of fitting written out; distances and sums are whole numbers."""
    sql = """
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
     x AS (SELECT r, p, list_transform(embedding[p * len(embedding) // 16 + 1:(p + 1) * len(embedding) // 16], lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM k, range(16) t(p)),
     b0 AS (SELECT p, r - 1 AS e, v FROM x WHERE r <= 64)"""
    for i in (0, 1, 2):
        sql += f""",
     d{i} AS MATERIALIZED (SELECT x.r, x.p, x.v, b.e, CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda j: (x.v[j] - b.v[j]) * (x.v[j] - b.v[j]))) AS BIGINT) AS d FROM x JOIN b{i} b ON x.p = b.p),
     a{i} AS MATERIALIZED (SELECT r, p, first(v) AS v, first(e ORDER BY d, e) AS e, min(d) AS d FROM d{i} GROUP BY r, p)"""
        if i < 2:
            sql += f""",
     m{i} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS v FROM (SELECT p, e, j, sum(v[j]) AS s, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS j FROM a{i}) GROUP BY p, e, j) GROUP BY p, e),
     b{i + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.e = m.e)"""
    return (
        sql
        + """,
     c AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
     h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c ON k.r = c.r, h"""
    )


ORACLES = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
     dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
     h AS (SELECT doc_id, item_id, dw.n, p FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
     c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
     s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN s ON d.doc_id = s.doc_id""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS h
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
     f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
     x AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM g JOIN f ON g.h = f.h WHERE doc_id > first),
     k AS (SELECT d.doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
     kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS t, count(*) AS n FROM k ANTI JOIN x ON k.doc_id = x.doc_id AND k.p = x.p GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op12_spelling_variants": r"""
WITH RECURSIVE t8 AS (SELECT i, 0 AS k, i AS c FROM range(256) r(i)
       UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t8 WHERE k < 8),
     tab AS (SELECT list(c ORDER BY i) AS t FROM t8 WHERE k = 8),
     runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents) GROUP BY ALL),
     hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) + 1),
              lambda p: ('0x' || hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w))[2 * p - 1:2 * p])::BIGINT)), lambda acc, b: xor(t[(xor(acc, b) & 255) + 1], acc >> 8)), 4294967295) AS h FROM runs, tab),
     words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed) GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
     less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
     near AS (SELECT DISTINCT a.word, a.n, b.word AS o, b.n AS m FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
       UNION SELECT DISTINCT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.s = b.word
       UNION SELECT DISTINCT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.s = b.word),
     best AS (SELECT word, count(*) AS n_near, first(o ORDER BY m DESC, o) AS o, max(m) AS m FROM near GROUP BY word),
     forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN o END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
     up AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT up.word, f.word, f.form FROM up JOIN forms f ON up.next = f.word)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM forms f JOIN up ON f.word = up.word AND up.next IS NULL""",
    "op13_vector_codes": _codes_sql(),
}
