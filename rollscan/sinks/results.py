"""K1 JSON sink, K2 CSV sink, K3 format dispatch.

Sinks write Spark output folders (one part file per task), so results of
any size are written in parallel.  ``json_array=True`` writes parts that
together are one JSON array: concatenated by name they are a valid document.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscan.operators.ordering import range_parts, total_order
from rollscan.operators.views import RESULT_COLUMNS, csv_view, order_columns

# Error messages of the format dispatch (same text as the reference).
MSG_NO_AUTO_FORMAT = (
    "Cannot auto-detect format from extension '{suffix}'. "
    "Use .json or .csv, or specify format explicitly."
)
MSG_UNSUPPORTED_FORMAT = "Unsupported export format: {fmt}. Use 'json' or 'csv'."


def resolve_format(output_path: str, fmt: str = "auto") -> str:
    """K3: explicit format wins; ``auto`` picks by suffix; anything else is an error.

    Checked before any job starts.
    """
    if fmt == "auto":
        suffix = os.path.splitext(output_path.rstrip("/"))[1].lower()
        if suffix == ".json":
            return "json"
        if suffix == ".csv":
            return "csv"
        raise ValueError(MSG_NO_AUTO_FORMAT.format(suffix=suffix))
    if fmt in ("json", "csv"):
        return fmt
    raise ValueError(MSG_UNSUPPORTED_FORMAT.format(fmt=fmt))


def write_json(results: DataFrame, output_path: str, json_array: bool = False, parts: int | None = None) -> None:
    """K1: JSON lines (default), or the parts of one JSON array document; null fields are kept as keys."""
    if json_array:
        json_array_lines(results, parts).write.mode("overwrite").text(output_path)
    else:
        results.write.mode("overwrite").option("ignoreNullFields", "false").json(output_path)


def json_array_lines(results: DataFrame, parts: int | None = None) -> DataFrame:
    """The lines of one JSON array, a row each, in as many ordered partitions as ``parts``.

    Every row knows its place in the result order, so the first row opens the
    array, the last one closes it and every other one begins with a comma: no
    part needs another one, and none has to hold all rows.
    """
    spark = results.sparkSession
    body = F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"})
    placed = total_order(results.select("*", body.alias("_json")), *order_columns(results), position="_pos")
    n = placed.count()
    if not n:
        return spark.createDataFrame([("[]",)], "value string")
    line = F.concat(
        F.when(F.col("_pos") == 1, F.lit("[")).otherwise(F.lit(",")), F.col("_json"), F.when(F.col("_pos") == n, F.lit("]")).otherwise(F.lit(""))
    )
    ranged = placed.repartitionByRange(parts or range_parts(n), "_pos").sortWithinPartitions("_pos")
    return ranged.select(line.alias("value"))


def write_csv(results: DataFrame, output_path: str) -> None:
    """K2: header ``file,page,name,father`` (+ bbox_* and confidence in box mode).

    Quotes are doubled inside quoted fields, white space is kept and rows end in
    CRLF as in Python's csv module; null box and confidence give empty cells; an
    empty result writes the header of text mode (four columns) in either mode.
    """
    rows = csv_view(results)
    if len(rows.columns) > len(RESULT_COLUMNS) and rows.isEmpty():
        rows = rows.select(RESULT_COLUMNS)
    (
        rows.write.mode("overwrite")
        .option("header", "true")
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .option("lineSep", "\r\n")
        .csv(output_path)
    )


def write_results(results: DataFrame, output_path: str, fmt: str = "auto", json_array: bool = False) -> str:
    """K3: validate the format first, then write; returns the format used."""
    chosen = resolve_format(output_path, fmt)
    if chosen == "json":
        write_json(results, output_path, json_array=json_array)
    else:
        write_csv(results, output_path)
    return chosen
