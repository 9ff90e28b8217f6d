"""Clusters of similar items: greedy ones by the smallest id, and those of models with votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

OPEN, TAKEN, PASSED = 0, 1, 2


def greedy_clusters(items: DataFrame, links: DataFrame, least: int = 3) -> DataFrame:
    """(id, cluster, weight) of the items in clusters, as one gets by going through the items in order of their ids.

    items: id, n (how often it occurs); links: x, y, each pair once.  An item that isn't taken forms a cluster with its
    neighbours that aren't taken, if they occur `least` times together; its cluster has its id, and its members are taken.
    An item that can't form one may still be taken by a later one.

    In a round all those items decide that have the smallest open id within two steps: what they take can't meet.  Items
    that couldn't form a cluster with all their neighbours are passed at once.
    """
    both = stored(links.selectExpr("x as a", "y as b").unionByName(links.selectExpr("y as a", "x as b")).filter("a <> b").distinct(), "cluster-links")
    around = both.unionByName(items.selectExpr("id as a", "id as b"))
    weigh = lambda state: around.join(state.selectExpr("id as b", "n", "status"), "b")
    state = items.select("id", "n", F.lit(OPEN).alias("status"), F.lit(None).cast(items.schema["id"].dataType).alias("cluster"))
    possible = weigh(state).groupBy("a").agg(F.sum("n").alias("most"))
    state = stored(state.join(possible, F.col("id") == F.col("a"), "left").select("id", "n", F.when(F.col("most") >= least, OPEN).otherwise(PASSED).alias("status"), "cluster"), "cluster-state")
    while state.filter(F.col("status") == OPEN).limit(1).count():
        near = stored(weigh(state).groupBy("a").agg(F.min(F.when(F.col("status") == OPEN, F.col("b"))).alias("first"), F.sum(F.when(F.col("status") != TAKEN, F.col("n"))).alias("weight")), "cluster-near")
        second = around.join(near.selectExpr("a as b", "first"), "b").groupBy("a").agg(F.min("first").alias("least_near"))
        ready = state.filter(F.col("status") == OPEN).select("id").join(second.filter("a = least_near").selectExpr("a as id"), "id").join(near.selectExpr("a as id", "weight"), "id")
        ready = stored(ready.withColumn("forms", F.col("weight") >= least), "cluster-ready")
        taken = around.join(ready.filter("forms").selectExpr("id as a"), "a").selectExpr("b as id", "a as by")
        state = state.join(taken, "id", "left").join(ready.select("id", F.lit(True).alias("decided")), "id", "left")
        takes = F.col("by").isNotNull() & (F.col("status") != TAKEN)
        state = stored(state.select("id", "n", F.when(takes, TAKEN).when(F.col("decided") & (F.col("status") == OPEN), PASSED).otherwise(F.col("status")).alias("status"), F.when(takes, F.col("by")).otherwise(F.col("cluster")).alias("cluster")), "cluster-state")
    return state.filter(F.col("status") == TAKEN).select("id", "cluster", F.col("n").alias("weight"))


def scaled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows with `features`, a vector of the columns, each of mean 0 and deviation 1."""
    rows = VectorAssembler(inputCols=list(features), outputCol="raw").transform(rows)
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows).drop("raw")


def by_volatility(rows: DataFrame, label: str) -> DataFrame:
    """The rows with labels numbered by rising mean volatility, so that several models' labels can be compared."""
    table = rows.groupBy(label).agg(F.avg("volatility").alias("v"), F.avg("trend").alias("t")).orderBy("v", "t").collect()  # a row a cluster
    order = F.create_map(*[F.lit(x) for k, r in enumerate(table) for x in (r[label], k)])
    return rows.withColumn(label, F.element_at(order, F.col(label)))


def clustered(rows: DataFrame, k: int = 4) -> DataFrame:
    """Scaled rows with `cluster`, of k-means."""
    return by_volatility(KMeans(k=k, seed=42, maxIter=20).setPredictionCol("cluster").fit(rows).transform(rows), "cluster")


def voted(rows: DataFrame, k: int = 4) -> DataFrame:
    """Scaled rows with the labels of two k-means and a mixture, put in one order, their majority, and the share that agrees."""
    for name, model in (("first", KMeans(k=k, seed=42)), ("second", KMeans(k=k, seed=123, initMode="random")), ("mixture", GaussianMixture(k=k, seed=42, maxIter=30))):
        rows = by_volatility(model.setPredictionCol(name).fit(rows).transform(rows).drop("probability"), name)
    a, b, c = F.col("first"), F.col("second"), F.col("mixture")
    winner = F.when((a == b) | (a == c), a).when(b == c, b).otherwise(F.least(a, b, c))
    share = sum((x == F.col("regime")).cast("int") for x in (a, b, c)) / F.lit(3.0)
    return rows.withColumn("regime", winner).withColumn("confidence", F.round(share, 6))
