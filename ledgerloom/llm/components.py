"""Connected components of an edge list by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_key, cut

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of the edges (a, b): label is the smallest vertex reachable.

    Each round takes the smallest label among a vertex and its neighbours and then the label of that label, so
    paths shorten geometrically. Minima fold before the shuffle. The edges of a hub, and the vertices that share a
    label, meet that vertex's or label's row by broadcast where they are more than a small part of all, so neither
    a hub of any degree nor a giant component is one task's. An empty edge list has no vertices; loops and repeated
    edges do no harm.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("label"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "v"))
    n_edges, n = both.count(), labels.count()
    for _ in range(MAX_ROUNDS):
        near = by_key(both, labels.withColumnRenamed("v", "b"), "b", "degree", n_edges).groupBy("a").agg(F.min("label").alias("near"))
        low = cut(labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.least("label", "near").alias("low"), "label", "degree"))
        share = low.groupBy("low").agg(F.count(F.lit(1)).alias("m"))
        jump = share.join(low.select(F.col("v").alias("low"), F.col("low").alias("top")), "low")
        after = by_key(low, jump, "low", "m", n).select("v", F.least("low", "top").alias("label"), "degree", (F.least("low", "top") != F.col("label")).alias("moved"))
        after = cut(after)
        labels = after.drop("moved")
        if after.filter("moved").isEmpty():
            return labels.select("v", "label")
    raise RuntimeError(f"labels still moved after {MAX_ROUNDS} rounds")


def relabelled(v: DataFrame, labels: DataFrame) -> DataFrame:
    """v (with a column v) and its label; vertices without edges are their own."""
    return v.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
