"""Positional windows without a single ordered task.

Rows get dense positions from bucket counts: a bucket is a range of the whole order of arrival, counts of buckets
(few) are summed in one task, rows are numbered within their bucket. Frames look back a bounded number of rows, so
each bucket also receives the tail of the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relational import OCC, Context, c, in_windows, lower, lowers
from tidemark.sources.store import stored

BUCKET = 1 << 14


def with_positions(df: DataFrame, name: str = "__pos") -> DataFrame:
    """Adds the 0-based position in order of arrival.

    Rows are range-partitioned by all of their order, so that rows behind one another's operators (a union's second
    side, a join's partners) are spread, too; stored, so that the ranges are read twice but found once.
    """
    ranged = stored(df.repartitionByRange(OCC).sortWithinPartitions(OCC).withColumn("__mid", F.monotonically_increasing_id()), "ranged")
    counts = ranged.groupBy(F.shiftright("__mid", 33).alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = ranged.withColumn("__part", F.shiftright("__mid", 33)).join(F.broadcast(starts), "__part")  # a row for each range
    return placed.withColumn(name, F.col("__start") + F.col("__mid").bitwiseAND((1 << 33) - 1)).drop("__part", "__start", "__mid")


@lowers("process_window")
def _process_window(node, ctx: Context, inputs: list[DataFrame]) -> DataFrame:
    """The body once over all windows, a hidden window key threaded through every operator."""
    p = node.params
    size, slide = p["size"], p["slide"]
    placed = with_positions(inputs[0])
    total = placed.agg(F.count(F.lit(1)).alias("__total"))
    low, high = F.greatest(F.lit(0), F.floor((c("__pos") - size) / slide) + 1), F.floor(c("__pos") / slide)
    ids = F.when(high >= low, F.sequence(low, high))
    rows = placed.withColumn("__win", F.explode(ids)).filter((c("__pos") >= c("__win") * slide) & (c("__pos") < c("__win") * slide + size))
    rows = rows.join(F.broadcast(total), c("__win") * slide + size <= c("__total")).drop("__total", "__pos")  # one row: complete windows only
    windows = rows.select("__win").distinct()
    body = lower(p["body"], in_windows(ctx, {p["leaf"].fingerprint: rows}, windows))
    return body.withColumn(OCC, F.concat(F.array(c("__win").cast("long")), OCC)).drop("__win")


@lowers("over")
def _over(node, ctx: Context, inputs: list[DataFrame]) -> DataFrame:
    p = node.params
    first, last = p["rows"]
    if ctx.keys:
        frame = Window.partitionBy(*map(c, ctx.keys)).orderBy(OCC).rowsBetween(first, last)
        return inputs[0].withColumn(p["output"], F.collect_list(F.struct(*map(c, p["columns"]))).over(frame))
    span = max(BUCKET, -first)
    placed = with_positions(inputs[0]).withColumn("__at", F.floor(c("__pos") / span))
    here = placed.withColumn("__guest", F.lit(False))
    tail = placed.filter(F.pmod(c("__pos"), F.lit(span)) >= span + first).withColumn("__at", c("__at") + 1).withColumn("__guest", F.lit(True))
    frame = Window.partitionBy("__at").orderBy("__pos").rowsBetween(first, last)
    framed = here.unionByName(tail).withColumn(p["output"], F.collect_list(F.struct(*map(c, p["columns"]))).over(frame))
    return framed.filter(~c("__guest"))


