"""Queries opN_<name> of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import toxicity
from tidemark.llm.merkle import fingerprint_edits
from tidemark.llm.packing import pack
from tidemark.llm.piece_dropout import encode_pieces
from tidemark.llm.run_length_index import byte_dedup
from tidemark.llm.shared import table
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_files import token_files
from tidemark.llm.voronoi import top_k


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS s FROM places
), firsts AS (
  SELECT s, min(doc_id) AS f FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(50)) AS pos FROM windows JOIN firsts USING (s) WHERE f < doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op10_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_merkle, op3_substring_dedup, op4_simhash, op5_toxicity, op6_piece_dropout, op7_token_counts, op8_packing, op9_voronoi_topk, op10_run_length_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op9_voronoi_topk": OP9_SQL}
