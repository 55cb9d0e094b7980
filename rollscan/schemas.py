"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

BBOX = T.StructType(
    [
        T.StructField("left", T.IntegerType()),
        T.StructField("top", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]
)

# One row per page of text (S3).
PAGES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)

# One row per OCR word.
WORDS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("page", T.IntegerType()),
        # reading order within the page: block, paragraph, line and word number in one
        T.StructField("word_pos", T.LongType()),
        T.StructField("block_num", T.IntegerType()),
        T.StructField("par_num", T.IntegerType()),
        T.StructField("line_num", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("bbox", BBOX),
    ]
)

# Searched names.
QUERIES = T.StructType(
    [T.StructField("query_pos", T.IntegerType()), T.StructField("query", T.StringType())]
)

# Column order of the OCR engine's TSV word output (level .. text).
OCR_TSV = T.StructType(
    [
        T.StructField("level", T.IntegerType()),
        T.StructField("page_num", T.IntegerType()),
        T.StructField("block_num", T.IntegerType()),
        T.StructField("par_num", T.IntegerType()),
        T.StructField("line_num", T.IntegerType()),
        T.StructField("word_num", T.IntegerType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("top", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)

ERRORS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

RESULT_ITEM = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("father", T.StringType()),
        T.StructField("bbox", BBOX),
        T.StructField("confidence", T.DoubleType()),
    ]
)

# Result ledger (K4): one row per (file, search) with all its result rows.
LEDGER = T.StructType(
    [
        T.StructField("file_hash", T.StringType()),
        T.StructField("names_hash", T.StringType()),
        T.StructField("threshold", T.IntegerType()),
        T.StructField("box_level", T.BooleanType()),
        T.StructField("min_confidence", T.DoubleType()),
        T.StructField("settings", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("pdf_path", T.StringType()),
        T.StructField("pdf_name", T.StringType()),
        T.StructField("num_names", T.IntegerType()),
        T.StructField("results", T.ArrayType(RESULT_ITEM)),
    ]
)
