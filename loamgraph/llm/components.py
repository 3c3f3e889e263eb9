"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.common import materialise


def _least(edges: DataFrame) -> DataFrame:
    """For directed edges (u, v): each with m, the least of u and all its v. Counts before the shuffle; a hot u is split by the join."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u").select("u", "v", F.least("u", "least").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of undirected edges (a, b): a row (node, component) for each node of an edge; component is its least node.

    Keys can be of any ordered type. Self-loops and repeated edges change nothing; edges with a null end are no
    edges. Rounds go on until nothing changes (about the
    logarithm of the longest path); each is written to the shared folder, so lineage stays short. An empty table gives no rows.
    """
    now = materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        met = _least(large)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u <> v").distinct(), "edges")
        before, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
