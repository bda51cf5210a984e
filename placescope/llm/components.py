"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from placescope.session import materialize

#: Links that a task of a step takes at least, and tasks of a step if there are fewer links.
LINKS_A_TASK, LEAST_TASKS = 8192, 8


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The links as a table, with their number and the sum of their hashes, counted as they are written."""
    seen = Observation()
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")), "links")
    return table, (seen.get["n"], int(seen.get["s"] or 0))


def _step(edges: DataFrame, tasks: int) -> DataFrame:
    """A large-star and a small-star step: what each link becomes, written once.

    The smaller neighbours of a node are the lower ends of the links that it is the higher end of, so that the
    large star needs only each node's least one. Sort-merge however few the links are: what a broadcast leaves
    behind, its table and its thread, the driver would hold once for every join of every step.
    """
    least = edges.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("m"))
    # The columns are made behind the coalesce, which the next shuffle would else replace.
    large = edges.join(least.hint("merge"), "lo", "left").coalesce(tasks).select("hi", F.coalesce("m", "lo").alias("lo")).repartition("hi")
    root = large.groupBy("hi").agg(F.min("lo").alias("m"))
    ends = F.explode(F.array("hi", "lo")).alias("hi")
    return large.join(root.hint("merge"), "hi").select(ends, F.col("m").alias("lo")).filter("hi <> lo").coalesce(tasks).distinct().coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the smallest node reachable.

    Each step hangs neighbours on the smallest one; stars remain after a number of steps that is
    logarithmic in the longest path. Every step is written, so a lost executor costs one step. Only two
    figures of the table reach the driver, and a step is one query of a few shuffles.

    No step has more links than there are at first. Tasks are as many as they need, whatever the number of
    shuffle partitions, so that a step on few links does not leave hundreds of tiny files behind.
    """
    ordered = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    edges, state = _written(ordered)
    while state[0]:
        edges, new = _written(_step(edges, max(LEAST_TASKS, state[0] // LINKS_A_TASK)))
        if new == state:
            break
        state = new
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
