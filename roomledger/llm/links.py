"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.session import materialize


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).collect()[0])


def components(links: DataFrame) -> DataFrame:
    """``links``: ``a``, ``b`` long. Returns ``node``, ``root``: the smallest node that each node reaches.

    Only nodes with links come back. Links are joined again and again to the smallest neighbour, first of
    the larger neighbours of a node and then of the smaller ones, until every component is a star around
    its smallest node; the number of rounds grows with the logarithm of the nodes. Every round is written
    to the shared folder. Links with a NULL end or with equal ends say nothing and are left out.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        larger = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        larger = materialize(larger)
        low = larger.groupBy("a").agg(F.min("b").alias("low"))
        smaller = larger.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = materialize(smaller.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
