"""Filters and limits: F1, F4, F5/L2, F6, F7, L1, P1 helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscan.functions.text import py_strip


def pdf_suffix(path_col: str = "path") -> Column:
    """lower-cased file name ends with ``.pdf``."""
    return F.lower(F.col(path_col)).endswith(".pdf")


def normalize_path(c: Column) -> Column:
    """Collapse ``//``, ``/./`` and ``seg/..`` of an absolute path, purely lexically."""
    parts = F.filter(F.split(c, "/", -1), lambda s: (s != "") & (s != "."))

    def step(acc, seg):
        return F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.array_append(acc, seg)
        )

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def within_base(path_col: str, base: str) -> Column:
    """normalised path equals the base or lies strictly under it.

    The reference's bare prefix test also admits a sibling ``/base2``; this
    one does not.
    """
    p = normalize_path(F.col(path_col))
    b = normalize_path(F.lit(base))
    return (p == b) | p.startswith(F.concat(F.when(b == "/", F.lit("")).otherwise(b), F.lit("/")))


def cap_pages(pages: DataFrame, max_pages: int | None, page_col: str = "page") -> DataFrame:
    """Keep pages 1..max_pages (pushed to the scan as a range filter); ``None``: all pages."""
    return pages if max_pages is None else pages.where(F.col(page_col) <= F.lit(int(max_pages)))


def truncated_files(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """F5's report: one ``warning`` row in the errors schema for every file with pages beyond the cap."""
    last = pages.groupBy("path").agg(F.max("page").alias("last"))
    cut = last.where(F.lit(False) if max_pages is None else F.col("last") > F.lit(int(max_pages)))
    return cut.select(
        "path",
        F.lit(None).cast("int").alias("page"),
        F.lit("warning").alias("level"),
        F.format_string("searched the first %d of %d pages", F.lit(int(max_pages or 0)), F.col("last")).alias("message"),
    )


def filter_words(words: DataFrame, min_confidence: float) -> DataFrame:
    """strip word text, drop empty words and words below the confidence floor."""
    return words.withColumn("text", py_strip("text")).where(
        (F.col("text") != "") & (F.col("confidence") >= F.lit(float(min_confidence)))
    )


def clean_names(names: DataFrame, name_col: str = "query") -> DataFrame:
    """strip names and drop blanks."""
    return names.withColumn(name_col, py_strip(name_col)).where(F.col(name_col) != "")


def first_names(names: DataFrame, n: int, pos_col: str = "query_pos") -> DataFrame:
    """L1: the first ``n`` names in file order.

    A filter on the stored position instead of a global sort + limit, so it
    stays distributed; positions are consecutive after ``clean_names`` +
    renumbering in the name source.
    """
    return names.where(F.col(pos_col) <= F.lit(int(n)))
