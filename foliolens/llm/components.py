"""Connected components of a graph given as narrow rows, by rounds of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Large-star and small-star rounds: each links nodes to the smallest neighbour, until every node
    is linked to the smallest of its component and to nothing else, which one aggregate tells. A node's smallest neighbour
    is an aggregate that combines before its shuffle, so a node with very many neighbours is no single task's work. Each
    round is written to the shared folder. Its joins are merged: every broadcast of a small round would leave a
    thread in the driver.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = stored(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least.hint("merge"), "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
                 .select("s.u", "s.v").where("u <> v").distinct())
        e = stored(small)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (u, v) that is a ``u`` is so once and never a ``v``."""
    ends = edges.selectExpr("u AS node", "1 AS up").unionByName(edges.selectExpr("v AS node", "0 AS up"))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 0 AND n > 1").isEmpty()
