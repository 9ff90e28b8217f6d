"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens) that only grows.  Documents are joined to it by
the digests of their normalised content and of the tokenizer file; of the contents without a count one representative
row each is encoded, and the new counts are appended.  Content is normalised no further than the counts allow: a null
text is an empty one.

An empty text has 0 tokens and is cached like any other.  Repeated rows each get their count.  Rows without a doc_id
are counted too.  Extra columns are ignored.  An absent or empty cache makes every content a miss.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import jobs
from .tokens import encoder, file_digest

CACHE = "content_digest binary, tokenizer_digest string, n_tokens long"


def _count(path: str):
    def run(batches):
        for batch in jobs.slices(batches, most=8 << 20):
            n = encoder(path).counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array(n)], ["content_digest", "n_tokens"])

    return run


def read_cache(spark, cache: str) -> DataFrame:
    """The cache's rows; none where nothing has been written yet."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document; counts that `cache` lacks are made and appended to it."""
    spark = docs.sparkSession
    version = file_digest(tokenizer)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("content_digest"))
    digests = jobs.stored(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest"), "digests")
    known = read_cache(spark, cache).filter(F.col("tokenizer_digest") == version)
    # one row stands for each content; it is found on the digests alone, so texts move once and copies don't
    row = F.xxhash64("doc_id").alias("row")
    missing = digests.join(known, "content_digest", "left_anti").groupBy("content_digest").agg(F.min(row).alias("row"))
    texts = rows.select("content_digest", row, "text").join(missing, ["content_digest", "row"], "left_semi")
    new = texts.select("content_digest", "text").mapInArrow(jobs.tidy(_count(tokenizer)), "content_digest binary, n_tokens long").dropDuplicates(["content_digest"])
    new.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    known = read_cache(spark, cache).filter(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return digests.join(known, "content_digest").select("doc_id", "n_bytes", "n_tokens")
