"""A corpus pipeline of five stages; each calls one operator, and all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import byte_bpe, decontaminate, jaccard_join, jobs, language_id, pii


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: those without letters, or unlike every language learned."""
    jobs.ship(spark)
    return language_id.known(docs, language_id.fit(docs.filter(~language_id.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of smallest doc_id."""
    jobs.ship(spark)
    found = jaccard_join.jaccard_components(docs).filter("doc_id is null or doc_id = component_id").select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_semi")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items go; a document that is mostly such passages goes whole."""
    jobs.ship(spark)
    return decontaminate.decontaminate(docs, jobs.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    jobs.ship(spark)
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left."""
    jobs.ship(spark)
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("known_language", known_language), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("personal_data", personal_data), ("encoded", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; each one's rows are written and read again."""
    docs = jobs.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = jobs.stored(stage(spark, docs, sf_dir), name)
    return docs
