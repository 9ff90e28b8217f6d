"""Queries of recall: text ranks of query batches, nearest vectors, both together, and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import search
from ..sources.shared import stored
from .registry import native

#: One vector in so many is a query.
EVERY = 20
#: Rows of a hybrid answer, weights of text and vector, and the least importance of a memory.
LIMIT, TEXT_WEIGHT, VECTOR_WEIGHT, LEAST_IMPORTANCE = 10, 0.3, 0.7, 0.5
#: From which similarity on a strategy repeats one that was warned of.
WARNED = 0.7

_WORDS = f"regexp_extract_all(lower({{}}), '{search.WORD}')"


def _bm25(docs: str, queries: str) -> str:
    """CTEs of BM25 in whole millionths: scores (q, doc, score) of all documents with a term of the query.  docs: doc, text, weight; queries: q, text."""
    return f"""
      d as (select doc, weight, {_WORDS.format("text")} as w from {docs} x where text is not null),
      n as (select count(*) as docs, avg(cast(len(w) as double)) as mean from d where len(w) > 0),
      c as (select doc, weight, length, term, count(*) as f from (select doc, weight, len(w) as length, unnest(w) as term from d) y group by all),
      p as (select term, doc, docs, f * {search.K1 + 1} / (f + {search.K1} * (1 - {search.B} + {search.B} * length / mean)) * weight as part from c, n),
      t as (select term, ln(1 + (max(docs) - count(*) + 0.5) / (count(*) + 0.5)) as idf from p group by term),
      a as (select q, term from (select distinct q, unnest({_WORDS.format("text")}) as term from {queries} z) v),
      qt as (select q, a.term, idf from a join t on a.term = t.term),
      scores as (select q, doc, cast(sum(cast(round(idf * part * {search.MICRO}) as bigint)) as bigint) as score from qt join p on qt.term = p.term group by q, doc)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")


def text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that each benchmark item ranks first."""
    index = search.build(documents(spark, sf_dir).withColumn("weight", F.lit(1.0)))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("q"), "text")
    return search.top_documents(search.query_terms(items, index), index, 10).select("q", F.col("doc").alias("doc_id"), (F.col("score") / search.MICRO).alias("score"), "k")


native(
    "r01_text_rank",
    text_rank,
    f"with {_bm25('(select doc_id as doc, text, 1.0 as weight from {documents})', '(select item_id as q, text from {benchmark})')} select q, doc as doc_id, score / {search.MICRO} as score, k from (select *, row_number() over (partition by q order by score desc, doc) as k from scores) r where k <= 10",
)


def _near_sql(k: int, where: str = "true") -> str:
    """The k nearest vectors of each query by cosine; ties by id."""
    dot = lambda a, b: f"list_dot_product({a}::double[], {b}::double[])"
    rows = f"(select vec_id, embedding from {{embeddings}} e0 where {where})"
    pair = f"(select a.vec_id as q, b.vec_id, {dot('a.embedding', 'b.embedding')} / sqrt({dot('a.embedding', 'a.embedding')} * {dot('b.embedding', 'b.embedding')}) as similarity from {rows} a join {rows} b on a.vec_id <> b.vec_id and a.vec_id % {EVERY} = 0)"
    return f"(select q, vec_id, round(similarity, 6) as similarity, k from (select *, row_number() over (partition by q order by round(similarity, 6) desc, vec_id) as k from {pair} p) x where k <= {k})"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


native("r02_vector_topk", lambda spark, sf_dir: search.nearest_vectors(vectors(spark, sf_dir), 5, EVERY).select("q", "vec_id", "similarity", "k"), f"select q, vec_id, similarity, k from {_near_sql(5)} t")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: text, and an importance from their quality; those of too little importance are left out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = documents(spark, sf_dir).join(labels, F.col("doc") == F.col("doc_id"), "left")
    return rows.select("doc", "text", F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.25).otherwise(0.75).alias("weight")).filter(F.col("weight") >= LEAST_IMPORTANCE)


_MEMORIES = f"(select doc, text, weight from (select d.doc_id as doc, text, case when quality = 1 then 1.0 when quality = 0 then 0.25 else 0.75 end as weight from {{documents}} d left join (select doc_id, min(quality) as quality from {{labels}} group by doc_id) l on d.doc_id = l.doc_id) m0 where weight >= {LEAST_IMPORTANCE})"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, doc, text_score, vector_score, weight): the best text hits full outer the best vector hits of each query, both from memories of enough importance.

    A query is a memory's first line and its vector.  The text score is BM25 times importance, as a share of the most that
    the query's terms could give; a vector hit that isn't among the best text hits has its text score looked up.
    """
    texts = memories(spark, sf_dir)
    held = stored(texts.select("doc", "weight"), "memories")
    index = search.build(texts)
    asked = search.query_terms(texts.filter(F.col("doc") % EVERY == 0).select(F.col("doc").alias("q"), F.element_at(F.split("text", "\n"), 1).alias("text")), index)
    texts = search.top_documents(asked, index, LIMIT + 1).filter("doc <> q").select("q", "doc", "score")
    near = search.nearest_vectors(vectors(spark, sf_dir).join(held.select(F.col("doc").alias("vec_id")), "vec_id", "left_semi"), 2 * LIMIT, EVERY).select("q", F.col("vec_id").alias("doc"), "similarity")
    both = stored(texts.join(near, ["q", "doc"], "full_outer").select("q", "doc", "score", "similarity"), "hits")
    missing = search.pair_scores(both.filter("score is null"), asked, index).withColumnRenamed("score", "looked_up")
    most = asked.groupBy("q").agg(F.sum(F.round(F.col("idf") * (search.K1 + 1) * search.MICRO).cast("long")).alias("most"))
    scored = both.join(missing, ["q", "doc"], "left").join(most, "q", "left").join(held.select("doc", "weight"), "doc")
    text = F.coalesce(F.coalesce("score", "looked_up") / F.col("most"), F.lit(0.0))
    return scored.select("q", "doc", F.round(text, 6).alias("text_score"), F.coalesce("similarity", F.lit(0.0)).alias("vector_score"), "weight")


_HITS = f"""with m as ({_MEMORIES[1:-1]}), {_bm25("m", f"(select doc as q, split_part(text, chr(10), 1) as text from m where doc % {EVERY} = 0)")},
      tx as (select q, doc, score from (select *, row_number() over (partition by q order by score desc, doc) as k from scores) r where k <= {LIMIT + 1} and doc <> q),
      vx as (select q, vec_id as doc, similarity from {_near_sql(2 * LIMIT, "vec_id in (select doc from m)")} n0),
      most as (select q, sum(cast(round(idf * {search.K1 + 1} * {search.MICRO}) as bigint)) as most from qt group by q),
      hits as (select h.q, h.doc, round(coalesce(s.score / most, 0.0), 6) as text_score, coalesce(h.similarity, 0.0) as vector_score, weight
               from (select coalesce(tx.q, vx.q) as q, coalesce(tx.doc, vx.doc) as doc, similarity from tx full outer join vx on tx.q = vx.q and tx.doc = vx.doc) h
               left join scores s on h.q = s.q and h.doc = s.doc left join most on h.q = most.q join m on h.doc = m.doc)"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten hits of each query by 0.3 of the text score and 0.7 of the similarity, times importance."""
    # the text score holds the importance already
    score = F.round(TEXT_WEIGHT * F.col("text_score") + VECTOR_WEIGHT * F.col("vector_score") * F.col("weight"), 5)
    return search._best(hits(spark, sf_dir).select("q", "doc", score.alias("score")), LIMIT).select("q", F.col("doc").alias("vec_id"), "score", "k")


native("r03_hybrid_search", hybrid, f"{_HITS} select q, doc as vec_id, score, k from (select *, row_number() over (partition by q order by score desc, doc) as k from (select q, doc, round({TEXT_WEIGHT} * text_score + {VECTOR_WEIGHT} * vector_score * weight, 5) as score from hits) s0) s1 where k <= {LIMIT}")
native("j10_full_outer_hits", lambda spark, sf_dir: hits(spark, sf_dir).select("q", F.col("doc").alias("id"), "text_score", "vector_score"), f"{_HITS} select q, doc as id, text_score, vector_score from hits")


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strategy's ten nearest others: which are similar enough to be a warning, and how many of the ten are."""
    near = search.nearest_vectors(vectors(spark, sf_dir), 10, EVERY).withColumn("warning", (F.col("similarity") > WARNED).cast("int"))
    return near.select("q", "vec_id", "similarity", "k", "warning", F.sum("warning").over(Window.partitionBy("q")).alias("warnings"))


native("r04_similar", warnings, f"select q, vec_id, similarity, k, case when similarity > {WARNED} then 1 else 0 end as warning, count_if(similarity > {WARNED}) over (partition by q) as warnings from {_near_sql(10)} t")


def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each query's five nearest vectors the hyperplane index meets, against all of them compared."""
    rows = vectors(spark, sf_dir)
    dim = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    index = search.Hyperplanes(rows, dim)
    found = index.nearest(rows.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("q")), 5)
    return search.recall(found, search.nearest_vectors(rows, 5, EVERY))


native("r02_index_recall", index_recall)
