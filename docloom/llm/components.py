"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import checkpoint


def _toward_min(edges: DataFrame) -> DataFrame:
    """Each edge as (hi, lo), hi > lo, once."""
    return edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()


def _meet(rows: DataFrame, node: str, least: DataFrame) -> DataFrame:
    """rows with c and m of least, where c is the row's node. Met over another form of the node, so that the rows are shuffled
    for this join as well as the minima: then Spark can split a node that has very many neighbours over tasks."""
    return rows.withColumn("__w", F.bitwise_not(node)).join(least.withColumn("__w", F.bitwise_not("c")), "__w").drop("__w")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node's neighbourhood."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return _meet(both.filter("v > u"), "u", least).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, is linked to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("c"), "m")
    down = _meet(edges, "hi", least)
    return down.select(F.col("lo").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node, a long, of a link; root is the least node of its component. Nodes without links don't appear.

    Self links and repeated links are ignored, an empty link table gives an empty result. Each round is checkpointed, and
    the rounds grow with the logarithm of the longest path. No node's neighbours meet in one row: steps only use minima,
    which are summed up before the shuffle, and joins whose hot keys Spark can split.
    """
    now = checkpoint(_toward_min(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    seen = None
    while True:
        now = checkpoint(_toward_min(_small_star(_toward_min(_large_star(now)))))
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if seen == tuple(sign):
            break
        seen = tuple(sign)
    star = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
