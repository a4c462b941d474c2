"""Best pairs by the inner product of vectors, without making the others as rows.

Both sides are dealt to blocks; a task takes one block of each side, scores them as matrices and passes on what may be
among the best: pairs near the k-th best of a row (matrix products may differ from the sums that rank them in the last
bits) are scored again in the order of ``product``, and of these the best k go on. A pair that is among the best of all
is among the best of its blocks, so the ranking over what is passed on is that over all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 8192  # rows of a side in a task
STEP = 256  # rows of one side that are scored at a time
NEAR = 1e-9  # far more than what two orders of summation of unit vectors differ by
NOTHING, UNKNOWN = -2.0, 2.0  # stand for a null score, which ranks last, and NaN, which ranks first
COMPARES = {"eq": np.equal, "ne": np.not_equal, "lt": np.less, "le": np.less_equal, "gt": np.greater, "ge": np.greater_equal}
KEYS = ("string", "tinyint", "smallint", "int", "bigint", "boolean", "date")


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each vector, and which of them have a product: the others are null or of another width."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(vectors).to_pylist()], dtype=np.int64)
    whole = sizes == width
    out = np.zeros((len(sizes), width))
    out[whole] = vectors.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out, whole


def _codes(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of the values; nulls are apart from everything (NaN)."""
    at = {v: float(i) for i, v in enumerate(sorted({v for v in (*left, *right) if v is not None}))}
    return tuple(np.array([np.nan if v is None else at[v] for v in side]) for side in (left, right))


def _places(ids: list) -> np.ndarray:
    out = np.empty(len(ids), dtype=np.int64)
    out[sorted(range(len(ids)), key=lambda i: ids[i])] = np.arange(len(ids))
    return out


def _exact(a: np.ndarray, b: np.ndarray, unrolled: int) -> np.ndarray:
    """Products of rows, added up in the order of ``product``."""
    terms = a * b
    if terms.shape[1] > unrolled:
        out = np.zeros(len(terms))
        for i in range(terms.shape[1]):
            out += terms[:, i]
        return out
    while terms.shape[1] > 1:
        even = terms.shape[1] // 2 * 2
        terms = np.hstack([terms[:, :even:2] + terms[:, 1:even:2], terms[:, even:]])
    return terms[:, 0]


def _best(a, b, a_whole, b_whole, allowed, order, k: int | None, threshold: float | None, unrolled: int):
    """Of each row of ``a`` the best k of ``b``, ties by ``order``: positions in both, and scores."""
    found = []
    for at in range(0, len(a), STEP):
        rows = slice(at, at + STEP)
        scores = a[rows] @ b.T
        scores[np.isnan(scores)] = UNKNOWN
        scores[~a_whole[rows]] = NOTHING
        scores[:, ~b_whole] = NOTHING
        for compare, x, y in allowed:
            scores[~compare(x[rows, None], y[None, :])] = -np.inf
        low = np.full(len(scores), -3.0)
        if threshold is not None:
            low[:] = threshold - NEAR
        if k is not None and k < scores.shape[1]:
            low = np.maximum(low, np.partition(scores, -k, axis=1)[:, -k] - NEAR)
        i, j = np.nonzero(scores >= low[:, None])
        exact = scores[i, j]
        real = np.flatnonzero((exact > NOTHING + 0.5) & (exact < UNKNOWN - 0.5))
        for p in range(0, len(real), 1 << 16):
            part = real[p : p + (1 << 16)]
            exact[part] = _exact(a[i[part] + at], b[j[part]], unrolled)
        if threshold is not None:
            kept = exact >= threshold
            i, j, exact = i[kept], j[kept], exact[kept]
        if k is not None and len(i):
            by = np.lexsort((order[j], -exact, i))
            i, j, exact = i[by], j[by], exact[by]
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            place = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
            i, j, exact = i[place < k], j[place < k], exact[place < k]
        found.append((i + at, j, exact))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def promising(left: DataFrame, right: DataFrame, ids: tuple[str, str], keys: Sequence[tuple[str, str, bool]], rest: Sequence[tuple[str, str, str]], vectors: tuple[str, str], width: int, profile: dict, unrolled: int) -> DataFrame:
    """(both ids, ``__score``) of pairs with equal ``keys`` (left, right, whether nulls are equal) that meet ``rest``
    (comparison, left, right): all that ``screened`` keeps by ``profile``, and few others."""
    sides = []
    for i, (df, own, vector) in enumerate(zip((left, right), ids, vectors, strict=True)):
        for key in keys:
            if not key[2]:
                df = df.filter(F.col(f"`{key[i]}`").isNotNull())
        key = F.to_json(F.struct(*(F.col(f"`{k[i]}`").alias(f"k{n}") for n, k in enumerate(keys)), F.lit(0).alias("k")))
        more = [F.col(f"`{r[i + 1]}`").alias(f"__c{n}") for n, r in enumerate(rest)]
        sides.append(df.select(key.alias("__key"), F.col(f"`{own}`").alias("__id"), F.col(f"`{vector}`").alias("__v"), *more))
    sizes = [s.groupBy("__key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(f"__n{i}")) for i, s in enumerate(sides)]
    blocks = sizes[0].join(sizes[1], "__key")
    dealt = []
    for i, s in enumerate(sides):
        here = F.pmod(F.xxhash64("__id"), F.col(f"__n{i}")).cast("int").alias(f"__b{i}")
        there = F.explode(F.sequence(F.lit(0), F.col(f"__n{1 - i}") - 1)).alias(f"__b{1 - i}")
        dealt.append(s.join(blocks, "__key").select(*s.columns, here, there).groupBy("__key", "__b0", "__b1"))
    kinds = [df.schema[x].dataType for df, x in zip((left, right), ids, strict=True)]
    k, per, threshold = profile.get("k"), profile.get("per", "left"), profile.get("threshold")
    compares = [r[0] for r in rest]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):  # a block that no row was dealt to
            return pa.table({ids[0]: a.column("__id").slice(0, 0), ids[1]: b.column("__id").slice(0, 0), "__score": pa.array([], pa.float64())})
        names = [a.column("__id").to_pylist(), b.column("__id").to_pylist()]
        (x, x_whole), (y, y_whole) = _matrix(a.column("__v"), width), _matrix(b.column("__v"), width)
        codes = [_codes(a.column(f"__c{n}").to_pylist(), b.column(f"__c{n}").to_pylist()) for n in range(len(compares))]
        ours = [(COMPARES[op], *c) for op, c in zip(compares, codes, strict=True)]
        theirs = [(lambda p, q, f=f: f(q, p), v, u) for f, u, v in ours]
        parts = []
        if per in ("left", "symmetric") or k is None:
            parts.append(_best(x, y, x_whole, y_whole, ours, _places(names[1]), k, threshold, unrolled))
        if per in ("right", "symmetric") and k is not None:
            j, i, s = _best(y, x, y_whole, x_whole, theirs, _places(names[0]), k, threshold, unrolled)
            parts.append((i, j, s))
        i, j, s = (np.concatenate(p) for p in zip(*parts, strict=True))
        _, once = np.unique(i * len(y) + j, return_index=True)
        i, j, s = i[once], j[once], s[once]
        score = pa.array(np.where(s == UNKNOWN, np.nan, s), mask=s == NOTHING)
        return pa.table({ids[0]: a.column("__id").take(pa.array(i)), ids[1]: b.column("__id").take(pa.array(j)), "__score": score})

    schema = f"`{ids[0]}` {kinds[0].simpleString()}, `{ids[1]}` {kinds[1].simpleString()}, __score double"
    return dealt[0].cogroup(dealt[1]).applyInArrow(run, schema)
