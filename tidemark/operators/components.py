"""Connected components over pairs: the smallest node that each node reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.store import stored


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node in a pair. Labels flow along links and are then followed one step further,
    each round from stored tables, until a round changes nothing."""
    links = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    links = stored(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = stored(links.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")).select(F.col("x").alias("node"), "root"), "labels")
    while True:
        heard = links.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("heard"))
        lower = labels.join(heard, "node").select("node", "root", F.least("root", "heard").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("further"))
        after = stored(lower.join(jump, "new", "left").select("node", "root", F.least("new", F.coalesce("further", "new")).alias("new")), "labels")
        changed = bool(after.filter("root <> new").take(1))
        labels = after.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
