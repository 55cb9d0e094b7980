"""Projections of result rows: P2 result, P3 CSV view, K7 report view, O1 order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscan.operators.ordering import total_order

RESULT_COLUMNS = ["file", "page", "name", "father"]


def result_view(matches: DataFrame, box_level: bool = False) -> DataFrame:
    """File, page, name, father (+ bbox = name box, confidence in box mode).

    Text mode has no bbox/confidence columns at all; box mode always has both,
    nullable (the reference writes the keys with ``None`` there).
    """
    cols = list(RESULT_COLUMNS)
    if box_level:
        cols += ["bbox", "confidence"]
    return matches.select(*cols)


def csv_view(results: DataFrame) -> DataFrame:
    """Flatten bbox to four columns and format confidence with two decimals.

    A null box gives empty cells; a null confidence gives an empty cell (the
    reference fails the whole export there, see SURVEY Q6).
    """
    cols = [F.col(c) for c in RESULT_COLUMNS]
    if "bbox" in results.columns:
        cols += [F.col(f"bbox.{k}").alias(f"bbox_{k}") for k in ("left", "top", "width", "height")]
    if "confidence" in results.columns:
        conf = F.col("confidence")
        # format_string of a null gives "null" cut to the precision; keep null instead.
        cols.append(F.when(conf.isNotNull(), F.format_string("%.2f", conf)).alias("confidence"))
    return results.select(*cols)


def report_view(results: DataFrame) -> DataFrame:
    """K7: the console table: File, Page, Name, Father / Guardian (+ Confidence)."""
    cols = [
        F.col("file").alias("File"),
        F.col("page").cast("string").alias("Page"),
        F.col("name").alias("Name"),
        F.col("father").alias("Father / Guardian"),
    ]
    if "confidence" in results.columns:
        conf = F.col("confidence")
        cols.append(
            F.when(conf.isNull(), F.lit("N/A"))
            .otherwise(F.format_string("%.1f%%", conf))
            .alias("Confidence")
        )
    return results.select(*cols)


ORDER_COLUMNS = ["path", "file", "page", "block_pos", "query_pos", "query"]


def order_columns(results: DataFrame) -> list[str]:
    """Columns of the deterministic order (file walk, page, record, query) that the rows have."""
    return [c for c in ORDER_COLUMNS if c in results.columns]


def ordered(results: DataFrame) -> DataFrame:
    """O1: the deterministic order, on request only (a range sort)."""
    return results.orderBy(*order_columns(results))


def positioned(results: DataFrame, position: str = "result_pos", parts: int | None = None) -> DataFrame:
    """O1 as a column: the place of every row in the deterministic order, from 1."""
    return total_order(results, *order_columns(results), position=position, parts=parts)
