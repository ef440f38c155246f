"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage works on all rows that the one before it kept, and returns the columns of documents; the last
returns token ids with their source spans.

Defined cases, for all stages: an empty table gives no rows; extra columns are carried through the first four stages
whatever their names, and the last returns its own columns only; rows are kept or dropped whole, but for secrets, which
are replaced within the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapath.llm import chosen_path, decontam, langid, secret_scan, sentencepiece_offsets
from terrapath.llm.common import written
from terrapath.llm.queries import held_out, model_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no identifiable language: null, empty and letterless texts, and scores under 0.5. Repeated rows
    and rows without doc_id are each judged; a null lang is filled in."""
    return langid.keep_identified(docs, langid.train(docs.where(~held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-copies, once if its row is repeated; documents
    without words group with none and stay."""
    return chosen_path.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; of rows without doc_id only those that hold one. With an empty
    benchmark all stay."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets within the texts; null texts stay null, and n_chars follows the text."""
    return secret_scan.redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, starts, stops, n_tokens), a row per row; a null text has the end id alone."""
    return sentencepiece_offsets.encode(docs, model_path()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Language identification and segmentation can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
