"""Corpus pipeline: language ID, quality, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again as the next stage's documents. All stages but the last return the columns of their documents.
Null ids, null and empty texts, repeated rows, extra columns and empty tables have the results that the operators
define: texts that are null or hold no letter leave in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runefold.llm import bpe, decontaminate, langid, minhash, quality
from runefold.llm.common import stored
from runefold.llm.queries import LANG_FOLDS, QUALITY_FOLDS, QUALITY_LEAST, held_out, split_pattern, table, vocabulary


def same_columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those that the classifier rejects go."""
    model = langid.train(docs, ~held_out(F.col("doc_id"), LANG_FOLDS, 1))
    return same_columns(langid.predict(docs, model, prefix="__rf_").where("not __rf_rejected"), docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), QUALITY_FOLDS, 0))
    return same_columns(quality.score(docs, model, name="__rf_score").where(F.col("__rf_score") >= QUALITY_LEAST), docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return same_columns(minhash.deduplicated(docs), docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return same_columns(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern(), keep=["doc_id"], with_ids=True)


STAGES = [
    ("language_id", language),
    ("quality", good_quality),
    ("near_dedup", distinct_texts),
    ("decontaminate", without_leaks),
    ("bpe_encode", tokens),
]

#: No SQL: language and quality models are trained inside the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
