"""The corpus pipeline: five stages from raw documents to token digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. run() writes every stage's result to the shared scratch folder and reads it
back as the next one's documents. Language identification and the two near-duplicate stages
have no SQL equivalent, so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testquarry.llm import bpe, langid, line_dedup, minhash_dedup, mixing
from testquarry.llm.common import SPACE, materialize, settle, unsigned_crc

#: Most ids that are broadcast, 8 bytes each; more meet the documents in a sorted join.
BROADCAST_IDS = 1_000_000
#: The mixture takes each document once at most, and this share of all tokens.
BUDGET_PERCENT, MAX_EPOCHS = 90, 1
#: Columns that the stages read.
READ = ("doc_id", "text", "lang", "source")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without those whose doc_id is in ids; rows without a doc_id stay."""
    ids = materialize(ids.select("doc_id").distinct(), "left-out")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def _renamed(docs: DataFrame) -> DataFrame:
    """docs with columns other than a stage reads under names that no result column has."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in READ else f"in_{i}") for i, c in enumerate(docs.columns)))


def _named(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names, from the result for _renamed(docs)."""
    return result.select(*(F.col(c if c in READ else f"in_{i}").alias(c) for i, c in enumerate(docs.columns)))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not recognised: no letter, or a score below the calibrated bound.

    A null or empty text has no letter. A null lang is not learned from, nor are rows without
    a doc_id; without any labelled text nothing is recognised. Repeated rows are judged
    alike; an empty table stays empty; columns of any name stay as they are.
    """
    settle(spark)
    model = langid.train(docs, F.coalesce(unsigned_crc(F.col("doc_id")) % 5 != 0, F.lit(True)))
    return _named(langid.identify(_renamed(docs), model).where("not lang_rejected"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one occurrence of each group of like lines; documents left without a word go.

    Null texts and texts that had no word before stay. The first occurrence by doc_id, a null
    one first, is kept; repeated rows count as one document and keep the same lines. n_chars
    follows the text where there is such a column; all others, whatever their names, stay.
    """
    settle(spark)
    clean = line_dedup.dedup_lines(_renamed(docs), shortest=1)
    clean = _named(clean.where((F.col("n_removed") == 0) | F.col("text").rlike(f"[^{SPACE}]")), docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of every group of near-duplicates, by doc_id.

    Null and empty texts and rows without a doc_id stay. Rows that share a doc_id stay or go
    together. An empty table stays empty; columns of any name stay as they are.
    """
    settle(spark)
    return _without(docs, minhash_dedup.near_duplicates(docs).where("not kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the target weights of domains, languages and sources take.

    A null lang or source is a leaf of its own; rows without a doc_id stay, and rows that
    share one stay if any of them is taken. Ties go by a seeded hash of the doc_id. An empty
    table stays empty; columns of any name stay as they are.
    """
    mixed = mixing.mix_documents(docs, budget_percent=BUDGET_PERCENT, max_epochs=MAX_EPOCHS)
    return _without(docs, mixed.groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies = 0"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the bytes they decode to, as digests.

    A null text counts as empty: no tokens. Null doc_ids and repeated rows stay; an empty
    table gives an empty result; other columns are dropped.
    """
    settle(spark)
    return bpe.digests(bpe.encode_decode(docs))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
