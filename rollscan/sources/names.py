"""Name lists (one searched name per line), with F7 and L1."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.functions.text import py_strip
from rollscan.operators.filters import first_names
from rollscan.params import SearchParams
from rollscan.sources.files import MB

# Python's universal newlines (the line ends recognised when a
# text file is iterated), the byte order mark, and the name-list messages
# (same text as the reference).
LINE_BREAKS = "\r\n|\r|\n"
BOM = "\ufeff"
MSG_TOO_LARGE = "Names file too large: {mb:.1f}MB (max: {max}MB)"
MSG_NOT_UTF8 = "Names file must be UTF-8 encoded"
MSG_NO_NAMES = "No names provided in file"


def names_from_texts(texts: DataFrame, params: SearchParams | None = None, text_col: str = "value") -> DataFrame:
    """Whole name-list texts (one row per file) → ``(path, query_pos, query)``.

    Lines are stripped and blank ones dropped (F7) before numbering, so
    ``query_pos`` runs 1, 2, … over the kept names of each file; with
    ``max_search_names`` only the first so many are kept (L1; reported by
    ``truncated_lists``).  A leading BOM is dropped.
    Every file is one row, so line order needs no sort.
    """
    params = params or SearchParams()
    text = F.regexp_replace(F.col(text_col), f"^{BOM}", "")
    lines = F.transform(F.split(text, LINE_BREAKS, -1), lambda s: py_strip(s))
    kept = F.filter(lines, lambda s: s != "")
    keep = [c for c in texts.columns if c != text_col]
    exploded = texts.select(*keep, F.posexplode(kept).alias("pos", "query"))
    names = exploded.select(*keep, (F.col("pos") + 1).cast("int").alias("query_pos"), "query")
    return names if params.max_search_names is None else first_names(names, params.max_search_names)


def truncated_lists(texts: DataFrame, params: SearchParams, text_col: str = "value") -> DataFrame:
    """L1's report: one ``warning`` row (path, page, level, message) for every list that the cap cuts."""
    whole = names_from_texts(texts, params.with_(max_search_names=None), text_col)
    cap = params.max_search_names
    counted = whole.groupBy("path").agg(F.max("query_pos").alias("n"))
    cut = counted.where(F.lit(False) if cap is None else F.col("n") > F.lit(int(cap)))
    return cut.select(
        "path", F.lit(None).cast("int").alias("page"), F.lit("warning").alias("level"),
        F.format_string("searched the first %d of %d names", F.lit(int(cap or 0)), F.col("n")).alias("message"),
    )


def load_names(spark: SparkSession, path: str, params: SearchParams | None = None) -> DataFrame:
    """S2 for one or many name files: size cap, UTF-8 check, then ``names_from_texts``.

    Raises ``ValueError`` with the reference's messages when a file is too
    large or not UTF-8, or when no name is left.  The checks are one small
    aggregate over the files' metadata and a validity flag.
    """
    params = params or SearchParams()
    raw = spark.read.format("binaryFile").load(path)
    checked = raw.select(
        "path",
        F.col("length"),
        F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"),
        F.col("content").cast("string").alias("value"),
    )
    limit = float(params.max_names_file_size_mb) * MB
    bad = checked.agg(
        F.max(F.col("length")).alias("max_len"),
        F.count_if(~F.col("utf8")).alias("not_utf8"),
    ).first()
    if bad["max_len"] is not None and bad["max_len"] > limit:
        raise ValueError(MSG_TOO_LARGE.format(mb=bad["max_len"] / MB, max=params.max_names_file_size_mb))
    if bad["not_utf8"]:
        raise ValueError(MSG_NOT_UTF8)
    texts = checked.select("path", "value")
    if params.max_search_names is not None:
        for row in truncated_lists(texts, params).limit(10).collect():
            warnings.warn(f"{row['path']}: {row['message']}", stacklevel=2)
    names = names_from_texts(texts, params)
    if names.limit(1).count() == 0:
        raise ValueError(MSG_NO_NAMES)
    return names


def names_from_list(spark: SparkSession, names: list[str], params: SearchParams | None = None) -> DataFrame:
    """Searched names given in the program, as one name-list text."""
    texts = spark.createDataFrame([("<list>", "\n".join(names))], "path string, value string")
    if params is not None and params.max_search_names is not None and len(names) > params.max_search_names:
        warnings.warn(f"searched the first {params.max_search_names} of {len(names)} names", stacklevel=2)
    return names_from_texts(texts, params)
