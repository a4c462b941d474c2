"""Connected components of a graph given as pairs, by alternating large-star and small-star rounds.

All steps are joins and aggregates over edges; each round is written to the shared folder, so lineage stays
short and a lost executor costs one step. Nodes or links are never collected; only a row count and a checksum
reach the driver. Joins back onto a hub's many rows are plain, so that adaptive execution can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of a pair that is not itself a root; stored."""
    edges = materialize(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        large = materialize(_large(edges), "edges")
        discard(edges)
        edges = materialize(_small(large), "edges")
        discard(large)
