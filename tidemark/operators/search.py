"""Retrieval over stored views: keyword, vector and graph search, rank fusion, reranking."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.relational import c
from tidemark.operators.semantic import cosine
from tidemark.sources.store import shared_dir, stored

ADDED = ("record_id", "rank", "score")
K1, B = 1.2, 0.75
SPLIT = 16 << 20  # bytes of input for each core, below which texts are dealt out anew
FEW = 10_000  # ranked rows that may be broadcast


@dataclass(frozen=True)
class BM25:
    columns: tuple[str, ...]


@dataclass(frozen=True)
class CosineSimilarity:
    column: str
    query: tuple[float, ...]
    candidate_limit: int | None = None
    min_score: float | None = None


@dataclass(frozen=True)
class BFS:
    origins: DataFrame
    edges: DataFrame  # (source, target)
    max_depth: int = 3


@dataclass(frozen=True)
class RRF:
    pass


@dataclass(frozen=True)
class CrossEncoder:
    """``score(query, texts)`` gives a number for each text."""

    score: Callable[[str, Sequence[str]], Sequence[float]]
    column: str = "text"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _is(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def _asked(query: str) -> list[str]:
    return sorted(set("".join(ch if ch.isalnum() else " " for ch in query.lower()).split()))


def bm25(docs: DataFrame, id_col: str, columns: Sequence[str], query: str) -> DataFrame:
    """(record_id, score): BM25 with k1 1.2 and b 0.75; documents without a query term are left out. The texts are cut
    into tokens once: their counts are stored, and both the totals and the scores are made of these. For
    many queries over one corpus, see ``Postings``."""
    asked = _asked(query)
    if not asked:
        return docs.select(c(id_col).alias("record_id"), F.lit(0.0).alias("score")).limit(0)
    texts = docs.select(c(id_col).alias("record_id"), F.concat_ws(" ", *map(c, columns)).alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * SPLIT:
        texts = texts.repartition(cores)  # a few large row groups would keep most cores idle
    words = texts.select("record_id", tokens(c("text")).alias("w"))
    counted = stored(words.select("record_id", F.size("w").alias("dl"), *(F.size(F.filter("w", _is(t))).alias(f"tf{i}") for i, t in enumerate(asked))), "counted")
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count(F.when(c(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(asked))))
    joined = counted.crossJoin(F.broadcast(totals))  # totals: one row
    score = F.lit(0.0)
    for i in range(len(asked)):
        score = score + _weight(c("n"), c(f"df{i}"), c(f"tf{i}"), c("dl"), c("avgdl"))
    return joined.select("record_id", score.alias("score")).filter("score > 0")


def _weight(n: Column, df: Column, tf: Column, dl: Column, mean: Column) -> Column:
    """What one term adds to a document's score."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


@dataclass(frozen=True)
class Postings:
    """A stored inverted index: a query reads the shards of its terms, and of these the row groups that may hold them."""

    spark: SparkSession
    path: str
    schema: object
    n: int
    mean: float
    SHARDS = 64

    @staticmethod
    def build(docs: DataFrame, id_col: str, columns: Sequence[str]) -> Postings:
        words = stored(docs.select(c(id_col).alias("record_id"), tokens(F.concat_ws(" ", *map(c, columns))).alias("w")), "words")
        facts = words.agg(F.count(F.lit(1)), F.avg(F.size("w"))).first()
        terms = words.select("record_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "record_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
        terms = terms.withColumn("shard", F.pmod(F.crc32("term"), F.lit(Postings.SHARDS)).cast("int"))
        path = f"{shared_dir(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
        terms.repartition("shard", F.pmod(F.xxhash64("record_id"), F.lit(8))).sortWithinPartitions("shard", "term").write.partitionBy("shard").parquet(path)
        return Postings(docs.sparkSession, path, terms.schema, facts[0], facts[1] or 0.0)

    def search(self, query: str) -> DataFrame:
        """(record_id, score) as ``bm25`` gives them."""
        asked = _asked(query)
        shards = [zlib.crc32(t.encode()) % self.SHARDS for t in asked]
        found = self.spark.read.schema(self.schema).parquet(self.path).filter(c("shard").isin(shards) & c("term").isin(asked))
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term asked
        scored = found.join(F.broadcast(df), "term").select("record_id", _weight(F.lit(self.n), c("df"), c("tf"), c("dl"), F.lit(self.mean)).alias("s"))
        return scored.groupBy("record_id").agg(F.sum("s").alias("score"))


def similar(docs: DataFrame, id_col: str, method: CosineSimilarity) -> DataFrame:
    """Default threshold: above 0.6; an explicit one may be met."""
    vector = F.array(*map(F.lit, map(float, method.query)))
    out = docs.select(c(id_col).alias("record_id"), cosine(c(method.column), vector).alias("score"))
    return out.filter(c("score") > 0.6 if method.min_score is None else c("score") >= method.min_score)


def reachable(origins: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(record_id, score 1.0) within 1..max_depth hops, whichever way an edge points; one join a hop."""
    both = edges.select("source", "target").unionByName(edges.select(c("target").alias("source"), c("source").alias("target"))).distinct()
    front = origins.select(c("record_id").alias("source")).distinct()
    seen = None
    for _ in range(max_depth):
        front = both.join(front, "source", "left_semi").select(c("target").alias("source")).distinct()
        seen = front if seen is None else seen.unionByName(front).distinct()
    return seen.select(c("source").alias("record_id"), F.lit(1.0).alias("score"))


def top(df: DataFrame, n: int) -> DataFrame:
    """The n best by score, ties by id, with their rank. The ranking runs over n rows."""
    best = df.orderBy(F.desc("score"), "record_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "record_id")))


def rrf(ranked: Sequence[DataFrame]) -> DataFrame:
    """Sum of 1 / rank over the methods."""
    out = ranked[0].select("record_id", "rank")
    for r in ranked[1:]:
        out = out.unionByName(r.select("record_id", "rank"))
    return out.groupBy("record_id").agg(F.sum(1.0 / F.col("rank")).alias("score"))


def search(docs: DataFrame, id_col: str, query: str, methods: Sequence, reranker=None, limit: int = 10) -> DataFrame:
    """``docs`` columns with record_id, rank, score. Without a reranker exactly one method."""
    if set(ADDED) & (set(docs.columns) - {id_col}):
        raise ValueError(f"columns {ADDED} are added by search")
    if reranker is None and len(methods) != 1:
        raise ValueError("several methods need a reranker")
    found = []
    for m in methods:
        if isinstance(m, BM25):
            found.append(top(bm25(docs, id_col, m.columns, query), limit * 2 if reranker else limit))
        elif isinstance(m, CosineSimilarity):
            found.append(top(similar(docs, id_col, m), m.candidate_limit or (limit * 2 if reranker else limit)))
        else:
            found.append(top(reachable(m.origins, m.edges, m.max_depth), limit * 2))
    if reranker is None:
        best = found[0]
    elif isinstance(reranker, RRF):
        best = top(rrf(found), limit)
    else:
        union = found[0].select("record_id")
        for f in found[1:]:
            union = union.unionByName(f.select("record_id"))
        texts = docs.select(c(id_col).alias("record_id"), c(reranker.column).alias("__text")).join(union.distinct(), "record_id")
        scorer = reranker.score

        @F.pandas_udf("double")
        def scored(text: pd.Series) -> pd.Series:
            return pd.Series(list(scorer(query, text.tolist())), dtype=float)

        best = top(texts.select("record_id", scored("__text").alias("score")), limit)
    best = F.broadcast(best) if limit <= FEW else best
    return docs.join(best, docs[f"`{id_col}`"] == best["record_id"])


@dataclass
class RetrievalQuery:
    """Named channels in order; each is a callable (spark, query) -> DataFrame. Equal channels run once."""

    channels: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)

    def run(self, spark: SparkSession, query: str) -> dict[str, DataFrame]:
        made: dict[int, DataFrame] = {}
        return {name: made.setdefault(id(f), f(spark, query)) for name, f in self.channels.items()}
