"""Connected groups of a table of links, in rounds of joins that Spark distributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullmap.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node and component, its smallest node, for all nodes of the links (a, b).

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    smallest neighbour, then its smaller ones. Links never grow in number by more than one per
    node, and the rounds grow with the logarithm of the nodes. Each round is stored.
    """
    edges = stored(_tidy(links.select("a", "b")), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # a > b in tidy links; a node's larger neighbours are the a of the links where it is b.
        large = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u")
        edges = _tidy(large.select(F.col("v").alias("a"), F.col("m").alias("b")))
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = stored(_tidy(small), "links")
        sign = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, larger node first, without loops."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    return links.select(a.alias("a"), b.alias("b")).filter("a <> b").distinct()
