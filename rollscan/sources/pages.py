"""S3: page texts, one row per page (``path, file, page, text``), with F5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.functions.text import basename
from rollscan.operators.filters import cap_pages
from rollscan.params import SearchParams


def read_pages(
    spark: SparkSession, path: str, fmt: str = "parquet", params: SearchParams | None = None
) -> DataFrame:
    """Read a pages table; a page cap, if set, is a range filter pushed into the scan (``truncated_files`` reports it)."""
    params = params or SearchParams()
    df = spark.read.format(fmt).load(path)
    if "file" not in df.columns:
        df = df.withColumn("file", basename(F.col("path")))
    return cap_pages(df.select("path", "file", F.col("page").cast("int").alias("page"), "text"), params.max_pdf_pages)


def pages_from_texts(texts: DataFrame, separator: str = "\f", text_col: str = "value") -> DataFrame:
    """Whole document texts with pages separated by ``separator`` (form feed by default)."""
    keep = [c for c in texts.columns if c != text_col]
    out = texts.select(*keep, F.posexplode(F.split(F.col(text_col), separator, -1)).alias("pos", "text"))
    out = out.withColumn("page", (F.col("pos") + 1).cast("int")).drop("pos")
    if "file" not in out.columns:
        out = out.withColumn("file", basename(F.col("path")))
    return out
