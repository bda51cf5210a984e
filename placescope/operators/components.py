"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placescope.session import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], int(r["s"] or 0)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the smallest node reachable.

    Each step hangs neighbours on the smallest one; stars remain after a number of steps that is
    logarithmic in the longest path. Every step is written, so a lost executor costs one step. Only two
    figures of the table reach the driver.
    """
    ordered = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    edges = materialize(ordered, "links")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialize(small.union(root.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
