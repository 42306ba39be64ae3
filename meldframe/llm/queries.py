"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from . import chat, decontaminate, hashing_index, idcoder, langid, licences, pieces, quality, toxicity
from .common import small_batches, table
from .neardup import near_duplicates


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.digests(chat.expanded(turns.unionByName(extra)))


def op3_marginal_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op4_context_mixing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return idcoder.digests(idcoder.write(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


def op9_offset_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), aligned=True)


def op10_minhash_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, threshold=0.8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index_hashing": op1_multi_index_hashing,
    "op2_prefix_target_chat": op2_prefix_target_chat,
    "op3_marginal_unigram_langid": op3_marginal_unigram_langid,
    "op4_context_mixing_ids": op4_context_mixing_ids,
    "op5_ordinal_toxicity": op5_ordinal_toxicity,
    "op6_pigeonhole_decontamination": op6_pigeonhole_decontamination,
    "op7_factorisation_quality": op7_factorisation_quality,
    "op8_licence_paragraphs": op8_licence_paragraphs,
    "op9_offset_sentencepiece": op9_offset_sentencepiece,
    "op10_minhash_bottom_k": op10_minhash_bottom_k,
}

_TURNS = """
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)"""


def _escaped_length(column: str) -> str:
    """Code points of the escaped column: one more for each backslash and control string."""
    return f"length({column})" + "".join(f" + (length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ["\\", *chat.CONTROL])


_CHAT_SQL = f"""
WITH {_TURNS},
sized AS (
  SELECT *, {len(chat.OPEN) + 1 + len(chat.CLOSE)} + {_escaped_length("role")} + {_escaped_length("text")} AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {"op2_prefix_target_chat": _CHAT_SQL}
