"""Run statistics: A1, A6, A9, E1.

One definition for every run (the reference's differ by mode, SURVEY Q8):
processed = files without a file-level error (ledger hits included),
failed = files with a file-level error, pages = pages searched in this run,
matches = result rows returned.  All counts are aggregates over outcome
tables (never accumulators, which retries would count twice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_PREVIEW = 10


def error_messages(errors: DataFrame) -> DataFrame:
    """E1 → the reference's error strings: ``<file>: <message>`` for file errors."""
    return errors.select(
        "path",
        "page",
        "level",
        F.when(F.col("level") == "page", F.concat(F.element_at(F.split("path", "/", -1), -1), F.lit(": "), F.col("message")))
        .otherwise(F.col("message"))
        .alias("message"),
    )


def run_stats(files: DataFrame, errors: DataFrame, pages: DataFrame, matches: DataFrame) -> DataFrame:
    """A1 + A6: one row ``files_processed, files_failed, pages_processed, matches_found, error_count, errors``.

    ``errors`` holds the first ten error messages in (path, page) order; the
    errors table holds all of them.

    ``files``: one row per discovered file (``path``); ``errors``: E1 table;
    ``pages``: pages searched in this run; ``matches``: result rows.  Every
    input is tagged with its kind and the union is counted in one aggregate
    (partial counts per task, one small final merge).
    """
    failed_files = errors.where(F.col("level") == "file").select("path").distinct()
    outcome = files.select("path").distinct().join(
        failed_files.withColumn("_failed", F.lit(True)), "path", "left"
    )
    first = error_messages(errors).orderBy("path", F.col("page").asc_nulls_first(), "message").limit(ERROR_PREVIEW)
    first = first.select(F.lit("message").alias("kind"), F.struct("path", F.col("page").cast("int").alias("page"), "message").alias("e"))
    kinds = (
        outcome.select(F.when(F.col("_failed"), "failed").otherwise("processed").alias("kind"))
        .unionByName(pages.select(F.lit("page").alias("kind")))
        .unionByName(matches.select(F.lit("match").alias("kind")))
        .unionByName(errors.select(F.lit("error").alias("kind")))
        .withColumn("e", F.lit(None).cast("struct<path:string,page:int,message:string>"))
        .unionByName(first)
    )
    return kinds.agg(
        F.count_if(F.col("kind") == "processed").alias("files_processed"),
        F.count_if(F.col("kind") == "failed").alias("files_failed"),
        F.count_if(F.col("kind") == "page").alias("pages_processed"),
        F.count_if(F.col("kind") == "match").alias("matches_found"),
        F.count_if(F.col("kind") == "error").alias("error_count"),
        F.transform(F.array_sort(F.collect_list("e")), lambda e: e["message"]).alias("errors"),
    )


def error_summary(errors: DataFrame, preview: int = ERROR_PREVIEW) -> DataFrame:
    """A9 + L3: error count, the first ``preview`` errors in (path, page) order, "… and N more".

    The preview is a top-k (``orderBy().limit()``: per-partition top-k and one
    small merge); the count is an aggregate; both meet in one aggregate over
    their union, so the full error list never goes to one task.
    """
    msgs = error_messages(errors)
    first = msgs.orderBy("path", F.col("page").asc_nulls_first(), "message").limit(int(preview))
    tagged = msgs.select(F.lit(1).alias("n"), F.lit(None).cast("struct<path:string,page:int,message:string>").alias("e"))
    tagged = tagged.unionByName(
        first.select(F.lit(0).alias("n"), F.struct("path", F.col("page").cast("int").alias("page"), "message").alias("e"))
    )
    agg = tagged.agg(
        F.sum("n").cast("long").alias("error_count"),
        F.array_sort(F.collect_list("e")).alias("_first"),
    )
    return agg.select(
        "error_count",
        F.transform("_first", lambda s: s["message"]).alias("first_errors"),
        F.when(
            F.col("error_count") > preview,
            F.format_string("... and %d more", F.col("error_count") - F.lit(preview)),
        ).alias("more"),
    )
