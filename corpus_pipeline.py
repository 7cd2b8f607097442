"""The corpus pipeline: language ID, quality, exact dedup, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return the columns
of ``docs``. Rows with null or empty texts, null identifiers and repeated rows go through each stage as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import dedup, langid, ngramjoin, packing, quality, queries, workspace

#: A document stays if so large a share of its letters is in one language, these fit the language so well, and its quality score is at
#: least this. Held-out texts of the languages learned fit by 0.83 or more, texts of languages left out by 0.76 or less mostly.
MIN_LANGUAGE, MIN_FIT, MIN_QUALITY = 0.5, 0.8, 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, those of which no language has half of the letters, and those that fit no learned language."""
    workspace.bound_batches(spark)
    model = langid.train(docs.where(~queries.held_out()))
    found = langid.with_spans(docs, model, out="__language")
    known = (F.col("__language.lang") != langid.UNKNOWN) & (F.col("__language.score") >= MIN_LANGUAGE) & (F.col("__language.fit") >= MIN_FIT)
    return found.where(known).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the compression classifier scores under the threshold."""
    model = quality.train(docs, queries.table(spark, sf_dir, "labels").where(~queries.held_out()))
    return quality.with_score(docs, model, out="__quality").where(F.col("__quality") >= MIN_QUALITY).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts, the row with the largest doc_id stays."""
    return dedup.deduplicate(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by links of the n-gram join, the row with the smallest doc_id stays. Texts without words link with nothing."""
    return ngramjoin.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens."""
    packed = packing.pack(docs, queries.BYTE_BPE)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("quality", good_quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: Models and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as a table in the shared folder and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = workspace.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
