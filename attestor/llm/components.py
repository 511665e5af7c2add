"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import hot_join, stored


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and all its partners."""
    near = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    near = near.select("u", F.least("u", "m").alias("m"), "n")
    return hot_join(pairs, near, "u", "n")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node that it reaches.

    Each round links all larger partners of a node to the smallest one, then
    the smaller ones; a logarithmic number of rounds leaves one star for each
    component.  Every round is stored, so the lineage stays short.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = stored(small.filter("u <> v").distinct(), "edges")
        was, seen = seen, _state(now)
        if seen == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
