"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.scratch import remove, written


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node with an edge; a component is named by its smallest node.

    Each round links every node to the smallest node it knows, first from the larger side, then
    from the smaller; the rounds grow with the logarithm of the graph, not with its diameter. Only
    a minimum per node is aggregated, so a node with very many edges is no special case.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    spark = edges.sparkSession
    now, path = written(edges.select(hi, lo).filter("hi <> lo").distinct(), "edges")
    seen = _fingerprint(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large, between = written(large.filter("hi <> lo").distinct(), "edges")
        remove(spark, path)

        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(root, "hi")
        small = linked.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(root.select("hi", F.col("m").alias("lo")))
        now, path = written(small.filter("hi <> lo").distinct(), "edges")
        remove(spark, between)
        after = _fingerprint(now)
        if after == seen:
            break
        seen = after
    members = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return members.union(now.select("lo", "lo").distinct())
