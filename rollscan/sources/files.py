"""S1 PDF file scan and F2/F3 file validation (+ P4, P5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.functions.text import basename
from rollscan.params import SearchParams

# PDF magic number, the byte size of one MB, and the validation
# messages (same text as the reference; %.1f takes the size in MB).
PDF_MAGIC = b"%PDF-"
MB = 1024 * 1024
MSG_TOO_LARGE = "PDF file too large: %.1fMB (max: {max}MB)"
MSG_NOT_PDF = "File is not a valid PDF: "


def scan_pdf_files(spark: SparkSession, root: str) -> DataFrame:
    """S1 + F1: every file under ``root`` (recursively) whose name ends in ``.pdf``, any case.

    Columns: ``path, modificationTime, length, content`` (binaryFile).  The
    ``content`` column is only read when a later step uses it (Catalyst
    prunes it otherwise), and a filter on ``length`` (``fits``) is pushed into
    the scan, so bytes of files beyond the size limit are never read.
    Spark's file index skips names starting with ``_`` or ``.``.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[pP][dD][fF]")
        .load(root)
    )


def size_mb(length: Column) -> Column:
    """Bytes → MB."""
    return length / F.lit(float(MB))


def file_error(path: Column, length: Column, content: Column, params: SearchParams) -> Column:
    """F2 then F3: the first failing check's message, or null for a valid file."""
    mb = size_mb(length)
    too_large = F.format_string(MSG_TOO_LARGE.format(max=params.max_pdf_size_mb), mb)
    not_pdf = F.concat(F.lit(MSG_NOT_PDF), path)
    return F.when(mb > F.lit(float(params.max_pdf_size_mb)), too_large).when(
        F.substring(content, 1, len(PDF_MAGIC)) != F.lit(bytearray(PDF_MAGIC)), not_pdf
    )


def fits(params: SearchParams) -> Column:
    """F2 on the length alone, in a form that the scan takes as a pushed filter."""
    return F.col("length") <= F.lit(int(float(params.max_pdf_size_mb) * MB))


def validate_files(files: DataFrame, params: SearchParams | None = None) -> DataFrame:
    """F2 + F3 + P1: add ``file`` (basename) and ``error`` (null when valid)."""
    params = params or SearchParams()
    return files.withColumn("file", basename(F.col("path"))).withColumn(
        "error", file_error(F.col("path"), F.col("length"), F.col("content"), params)
    )


def content_hash(content: str = "content") -> Column:
    """P5: SHA-256 hex of the file bytes."""
    return F.sha2(F.col(content), 256)
