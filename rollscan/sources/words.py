"""OCR word tables (OCR engine TSV output or Parquet) → ``words`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.schemas import OCR_TSV

# OCR TSV row level of a single word.
WORD_LEVEL = 5


def read_ocr_tsv(spark: SparkSession, path: str, source_suffix: str = ".tsv") -> DataFrame:
    """Read OCR TSV files (header row, tab separated, quoting off).

    ``path`` of a word row is the TSV file's path without ``source_suffix``
    (e.g. ``roll.pdf.tsv`` → ``roll.pdf``).  Non-word rows (levels 1-4, conf
    −1, empty text) are dropped later by the word filter.  ``word_pos`` is the
    OCR reading order built from block, paragraph, line and word numbers.
    """
    df = (
        spark.read.option("sep", "\t")
        .option("header", "true")
        .option("quote", "")
        .option("escape", "")
        .option("mode", "PERMISSIVE")
        .schema(OCR_TSV)
        .csv(path)
        .withColumn("_src", F.col("_metadata.file_path"))
    )
    # _metadata.file_path is a URL: strip the scheme and decode %xx (a literal '+' stays).
    src = F.url_decode(F.replace(F.col("_src"), F.lit("+"), F.lit("%2B")))
    src = F.regexp_replace(src, "^file:(//)?", "")
    src = F.regexp_replace(src, F.lit(source_suffix.replace(".", "\\.") + "$"), "")
    num = [F.col(c).cast("long") for c in ("block_num", "par_num", "line_num", "word_num")]
    word_pos = ((num[0] * 1000 + num[1]) * 1000 + num[2]) * 10000 + num[3]
    return df.where(F.col("level") == WORD_LEVEL).select(
        src.alias("path"),
        F.col("page_num").alias("page"),
        word_pos.cast("long").alias("word_pos"),
        "block_num",
        "par_num",
        "line_num",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.col("conf").alias("confidence"),
        F.struct("left", "top", "width", "height").alias("bbox"),
    )
