"""The training-data pipeline: toxicity, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import toxicity
from tidemark.llm.packing import pack
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import new_path, table
from tidemark.llm.simhash import drop_near_copies
from tidemark.llm.substring_dedup import drop_repeats


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays. SimHash ball hashing links first, an exact join the rest."""
    return drop_near_copies(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are taken out."""
    return drop_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("near_copies", near_copies_stage), ("substring_dedup", substring_stage), ("packing", packing_stage)]

#: SQL has no counterpart of the learned scores, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
