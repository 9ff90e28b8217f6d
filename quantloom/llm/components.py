"""Connected components by minimum labels with pointer jumping, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobs


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id reachable over `edges` (a, b: long), for nodes that have an edge.

    Each round takes the minimum label of the neighbours, then of the label's own node, so that long chains halve.
    Rounds are written to the shared folder; only a count of changed labels returns to the driver.
    """
    both = jobs.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = jobs.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("l").alias("n"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("l", "n").alias("l"), F.col("l").alias("was"))
        step = jobs.stored(step, "labels")
        up = step.select(F.col("node").alias("at"), F.col("l").alias("up"))
        jumped = step.join(up, step["l"] == up["at"], "left").select("node", F.least(F.coalesce("up", "l"), "l").alias("l"), "was")
        jumped = jobs.stored(jumped, "labels")
        changed = jumped.filter("l <> was").limit(1).count()
        labels = jumped.select("node", "l")
        if not changed:
            return labels.withColumnRenamed("l", "component")
