"""The corpus pipeline: language ID, toxicity, near-dedup, decontamination, SentencePiece encoding, each stage on what the last kept."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meldframe.llm import decontaminate, langid, neardup, pieces, toxicity
from meldframe.llm.common import few, rows_where, small_batches, stored, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: A document goes if its language's posterior is below this.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, of which no learned language is likely, or that are further from theirs than training documents are, go: null and empty
    texts among them. Model and limits are learnt from all training documents, not a sample. Of repeated rows all stay or all go; ids and other columns are only passed on; without rows or without labelled languages none stay."""
    model = langid.train_on_all(docs, PIECES)
    limits = langid.limits(docs, model)

    def likely(texts: list[str | None]) -> np.ndarray:
        said, score, best, rate, size = model.judge(texts)
        return (np.array(said, object) != langid.UNKNOWN) & (score >= LEAST_LANGUAGE_SCORE) & limits.hold(best, rate, size)

    return rows_where(docs, likely)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The model learns from a sample of the labels of all documents; without labels none are toxic. Null and empty texts are not toxic;
    of repeated rows all stay or all go; null ids and other columns are passed on."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows_where(docs, lambda texts: model.exceed(texts)[:, 0] < 0.4)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; of rows with one id, or without an id and with one text, the least row."""
    gone = neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256)), F.lit("neither"))
    again = stored(docs.groupBy(own.alias("_again")).count().where("count > 1").select("_again"), "repeated")
    if again.isEmpty():
        return left
    match = own == F.col("_again")
    least = F.min(F.struct("text", *(c for c in docs.columns if c != "text"))).alias("_row")
    one = left.join(few(again), match).groupBy("_again").agg(least).select(*(F.col(f"_row.{c}").alias(c) for c in docs.columns))
    return left.join(few(again), match, "left_anti").unionByName(one)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay; of repeated rows all stay or all go; without items all stay."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of each document that is left."""
    small_batches(spark)
    return pieces.encode(docs, PIECES).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language), ("toxicity", clean), ("minhash_near_dedup", dedup), ("decontamination", decontaminated), ("sentencepiece", tokens)]

#: No stage but the last is within SQL's reach; tests/llm holds the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
