"""Exact top-k by inner product: a Voronoi join of queries and vectors.

Pivots come from a bounded sample; every vector goes to its nearest pivot's cell. A cell's summary is its row
count, its radius r and its largest norm (at most MAX_PIVOTS rows). For a query q, a vector x of the cell of p
obeys q.x <= q.p + |q| r, and, with the widest angle a between p and a member, q.x <= |q| max|x| cos(angle(q, p) - a).
A query is solved in its own cell first, which gives a score that k candidates reach; a cell whose
upper bound is below it is not needed. Queries are grouped by their own cells; a data row is sent only to the
groups that need its cell, in blocks of bounded size, and each (group, block) pair is solved by one matrix
product. No pair of rows is ever a shuffled row; a hot cell or a repeated vector only makes more blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize

MAX_PIVOTS, SAMPLE = 1024, 16384
BLOCK = 16384  # data rows of a block
GROUP = 8192  # queries of a group


def scaled_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v): v as floor(scale * x); vectors null, empty, or with null or non-finite components are left out."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    whole = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(whole).select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integer lists as a matrix; shorter rows are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first pivots of distinct sample rows, starting at the row nearest to the mean."""
    points = np.unique(sample, axis=0).astype(np.float64)
    at = [int(((points - points.mean(0)) ** 2).sum(1).argmin())]
    gap = ((points - points[at[0]]) ** 2).sum(1)
    while len(at) < min(most, len(points)) and gap.max() > 0:
        at.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[at[-1]]) ** 2).sum(1))
    for _ in range(4):  # a few rounds of means: tighter cells
        near = _nearest(points, points[at] if isinstance(at, list) else at)[0]
        at = np.stack([points[near == c].mean(0) if (near == c).any() else (points[at] if isinstance(at, list) else at)[c] for c in range(len(at))])
    return at


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float64)
    d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None]
    cell = d.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _cells(width: int, pivots: np.ndarray, kind: str):
    """Adds to each vector its cell, the distance and the angle to the pivot, and its norm."""
    lengths = np.sqrt((pivots * pivots).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), width).astype(np.float64)
                cell, gap = _nearest(x, pivots)
                norm = np.sqrt((x * x).sum(1))
                cosine = (x * pivots[cell]).sum(1) / np.maximum(norm * lengths[cell], 1e-300)
                angle = np.where(norm > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)
                names = ["vec_id", "v", "cell", "gap", "norm", "angle"]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), *map(pa.array, (gap, norm, angle))], names=names)

    return run, f"vec_id long, v array<{kind}>, cell int, gap double, norm double, angle double"


def _upper(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Upper bound of the inner product of each query with any vector of each cell."""
    mid, size = x @ pivots.T, np.sqrt((x * x).sum(1))[:, None]
    ball = size * radius[None]
    between = np.arccos(np.clip(mid / np.maximum(size * np.sqrt((pivots * pivots).sum(1))[None], 1e-300), -1, 1))
    cone = size * norm[None] * np.cos(np.maximum(0.0, between - angle[None] - 1e-6))
    cone = np.where(cone < 0, np.inf, cone)  # a short vector may be above it: no bound
    return np.minimum(mid + ball, cone) + 1e-9 * (np.abs(mid) + ball) + 1


def _solver(width: int, number: type, k: int):
    """The k best of the given rows for each query, by matrix products of bounded size."""

    def solve(asking: pa.Table, given: pa.Table) -> pa.Table:
        made: list[list] = [[], [], []]
        if asking.num_rows and given.num_rows:
            q_ids, ids = asking.column("vec_id").to_numpy(), given.column("vec_id").to_numpy()
            q = _matrix(asking.column("v").combine_chunks(), width).astype(number)
            x = _matrix(given.column("v").combine_chunks(), width).astype(number)
            step = max(1, (1 << 21) // len(x))
            for at in range(0, len(q), step):
                scores = q[at : at + step] @ x.T
                for i, s in zip(q_ids[at : at + step], scores, strict=True):
                    other = np.flatnonzero(ids != i)
                    best = other[_top(s[other], ids[other], k)]
                    made[0].append(np.full(len(best), i))
                    made[1].append(ids[best])
                    made[2].append(s[best].astype(np.int64))
        return pa.table([pa.array(np.concatenate([np.empty(0, np.int64), *c]), pa.int64()) for c in made], names=["query_id", "vec_id", "score"])

    return solve


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", query_every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id ``query_every`` divides, against all other rows.

    Rows with a query's own id are no candidates of it; a repeated query row counts once, other repeated
    rows each; rows with a null id, or whose vector is null, empty or not finite, take no part. An empty table, or
    no query, gives no rows. Scores that 64 bits might not hold are an error.
    """
    spark = vectors.sparkSession
    scaled = scaled_vectors(vectors, id_col, vec_col)
    facts = scaled.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, e: F.greatest(a, F.abs(e)))).alias("most")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    width = facts["width"]
    if facts["most"] ** 2 * width >= 1 << 63:
        raise ValueError("scores of these vectors do not fit in 64 bits")
    number = np.float64 if facts["most"] ** 2 * width < 1 << 53 else np.int64  # products and sums are whole in a double
    kind = "short" if facts["most"] < 1 << 15 else "long"
    found = materialize(scaled.select("vec_id", F.col("v").cast(f"array<{kind}>").alias("v")), "vectors")
    sample = found.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    pivots = choose_pivots(_matrix(sample, width), min(MAX_PIVOTS, math.isqrt(facts["n"])))
    n_cells = len(pivots)
    run, celled_schema = _cells(width, pivots, kind)
    celled = materialize(found.mapInArrow(run, celled_schema), "cells")
    is_query = F.col("vec_id") % query_every == 0
    summary = celled.groupBy("cell").agg(F.count(F.lit(1)), F.max("gap"), F.max("norm"), F.max("angle"), F.count(F.when(is_query, 1))).collect()  # a row for each pivot
    count, asked = np.zeros(n_cells, np.int64), np.zeros(n_cells, np.int64)
    radius, norm, angle = np.zeros(n_cells), np.zeros(n_cells), np.zeros(n_cells)
    for s in summary:
        count[s[0]], radius[s[0]], norm[s[0]], angle[s[0]], asked[s[0]] = s[1:]
    blocks = np.maximum(1, -(-count // BLOCK))
    # Query groups: neighbouring cells share one, a cell with many queries has several.
    line = np.argsort(pivots @ np.linalg.svd(pivots - pivots.mean(0), full_matrices=False)[2][0], kind="stable")
    first_group, ways, at, filled = np.zeros(n_cells, np.int64), np.maximum(1, -(-asked // GROUP)), 0, 0
    for c in line:
        if filled and filled + asked[c] > GROUP:
            at, filled = at + 1, 0
        first_group[c] = at
        filled += asked[c]
        if ways[c] > 1:
            at, filled = at + int(ways[c]), 0

    def of(name: np.ndarray, cell) -> object:
        return F.element_at(F.array(*(F.lit(int(n)) for n in name)), cell + 1)

    solve, pairs = _solver(width, number, k), "query_id long, vec_id long, score long"
    data = celled.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), of(blocks, F.col("cell"))).cast("int")).select("cell", "block", "vec_id", "v")
    queries = celled.filter(is_query).select("vec_id", "v", "cell").dropDuplicates(["vec_id", "v"])
    dealt = (F.floor(F.col("vec_id") / query_every) * 2654435761).bitwiseAND((1 << 32) - 1)
    queries = materialize(queries.withColumn("grp", of(first_group, F.col("cell")) + F.pmod(dealt, of(ways, F.col("cell")))), "queries")

    def solved(asking: DataFrame) -> DataFrame:
        """``asking``: queries with the cell that each is to be solved in."""
        wanted = materialize(asking.select("cell", "grp").distinct(), "needed")
        sent = data.join(wanted, "cell").select("grp", "cell", "block", "vec_id", "v")
        parts = asking.withColumn("block", F.explode(F.sequence(F.lit(0), of(blocks, F.col("cell")) - 1))).select("grp", "cell", "block", "vec_id", "v")
        keys = ("grp", "cell", "block")
        return parts.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, pairs)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with each further cell that may hold a better score."""
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), width).astype(np.float64)
                floor = b.column("floor").to_numpy(zero_copy_only=False)
                need = (_upper(x, pivots, radius, norm, angle) >= floor[:, None]) & (count[None] > 0)
                need[np.arange(len(x)), b.column("cell").to_numpy()] = False
                row, c = np.nonzero(need)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("v").take(at), pa.array(c, pa.int32()), b.column("grp").take(at)], names=["vec_id", "v", "cell", "grp"])

    home = materialize(ranked(solved(queries)), "home")
    floors = home.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    asking = queries.join(floors, queries.vec_id == floors.query_id, "left").select("vec_id", "v", "cell", "grp", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    asking = materialize(asking.mapInArrow(needed, f"vec_id long, v array<{kind}>, cell int, grp long"), "asking")
    return ranked(home.drop("rank").unionByName(solved(asking)))
