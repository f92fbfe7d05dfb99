"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgewise.session import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(pairs: DataFrame) -> DataFrame:
    """The least of each ``u`` and its neighbours; the aggregation combines before it shuffles."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each greater neighbour of a node to the least of the node and its neighbours."""
    pairs = _both_ways(edges)
    return pairs.join(_least(pairs), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its lesser neighbours to the least of them; ``u`` is greater than ``v`` in each edge."""
    least = _least(edges)
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of an edge but the roots themselves.

    ``edges`` has ``u`` and ``v`` of one type, in either order and repeated at will; loops and nulls are left out.
    Each pass reads what the last one wrote, and passes are few: about the logarithm of the longest path.
    """
    told = edges.select("u", "v").filter("u != v")
    now = stored(told.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        now = stored(_small_star(_large_star(now)), "edges")
