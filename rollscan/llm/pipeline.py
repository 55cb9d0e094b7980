"""Corpus pipeline: quality rules, near-dedup, secret scans, source mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet to the shared checkpoint folder and hands the
reread table to the next stage.  All stages but the last return the columns
of ``documents``; further columns of the input, whatever their names, are left
behind.

1. Quality rules drop the documents that they reject.  A null text has no words and is rejected as too short;
   rows whose ``doc_id`` is null or repeated are judged like any other.
2. Near-dedup leaves one document of each group (five-word shingles, Jaccard 0.8): the one with the least ``doc_id``,
   and of repeated rows of it the first by its other columns, so reruns keep the same row.  Documents without words,
   null texts among them, all stay.
3. The secret scan replaces every span it reports by ``[SECRET]`` and renews ``n_chars``; null texts and their
   ``n_chars`` stay as they are.
4. Mixing repeats or leaves out documents so that the sources meet their target weights; a null source is a source,
   rows of size 0 are never taken, ties in the draw go by a hash and reruns agree.
5. Packing returns the pieces of all documents with their sequence and offset; a null or empty text is one piece with
   the end-of-text id only, repeated rows are packed each.

An empty table gives empty results at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.llm.common import table
from rollscan.llm.mixing import mixed_rows
from rollscan.llm.near_dedup import drop_near_duplicates
from rollscan.llm.packing import pack_documents
from rollscan.llm.quality_rules import keep_good
from rollscan.llm.secret_scan import redact_secrets
from rollscan.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs.select(COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact_secrets(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs.select(COLUMNS)).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs.select(COLUMNS))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("secret scan", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokenising, MinHash and the splitting tree have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
