"""Record extraction: X1 block split, X2 labelled record extraction, F8."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscan.functions.text import field_pattern, guardian_pattern, name_pattern, py_strip
from rollscan.params import SearchParams

# Fixed value: record blocks are separated by exactly one blank line.
BLOCK_SEPARATOR = "\n\n"


def split_blocks(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per block of a page, ``block_pos`` from 0, left to right.

    ``split`` with limit -1 keeps empty blocks and splits non-overlapping from
    the left, exactly like ``str.split('\\n\\n')``.
    """
    keep = [c for c in pages.columns if c != text_col]
    return pages.select(
        *keep,
        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), BLOCK_SEPARATOR, -1)).alias(
            "block_pos", "block"
        ),
    )


@functools.lru_cache(maxsize=32)
def _first_record_columns(text_col: str, npat: str, gpat: str) -> tuple[Column, tuple[Column, ...]]:
    """One expression per page: every block's two patterns run exactly once (a
    Filter on extracted columns would be pushed below the Project and evaluate
    the patterns twice); only blocks with both fields are emitted.  Built once
    per pattern set and reused (Columns are immutable expressions)."""
    blocks = F.split(F.coalesce(F.col(text_col), F.lit("")), BLOCK_SEPARATOR, -1)
    found = F.transform(
        blocks,
        lambda b, i: F.struct(
            i.alias("block_pos"),
            F.regexp_extract(b, npat, 1).alias("_name"),
            F.regexp_extract(b, gpat, 2).alias("_father"),
            b.alias("_block"),
        ),
    )
    kept = F.filter(found, lambda r: (r["_name"] != "") & (r["_father"] != ""))
    finish = (
        F.col("block_pos"),
        py_strip("_name").alias("name"),
        py_strip("_father").alias("father"),
        F.regexp_extract("_block", gpat, 1).alias("relation"),
    )
    return F.inline(kept), finish


def extract_records(
    pages: DataFrame, params: SearchParams | None = None, text_col: str = "text"
) -> DataFrame:
    """X2 + F8: per block, the first name field and the first guardian field.

    A record exists only when both labels match in the block (tested before
    stripping, so a captured blank still counts).  Output: the page's key
    columns, ``block_pos``, ``name``, ``father`` and ``relation`` (which
    guardian label matched).  With ``all_records`` every name of a block pairs
    with the guardian field that follows it before the next name; the first
    name may also take the guardian field that opens the block, if none
    follows it.  A name without one gives no record.  Name labels are then
    anchored to line starts (a guardian label ends with the name label), and
    ``record_pos`` is the name's number in the block.
    """
    params = params or SearchParams()
    label = params.name_label
    npat = name_pattern(params.strict_labels, label)
    gpat = guardian_pattern(tuple(params.guardian_labels))
    if not params.all_records:
        keep = [c for c in pages.columns if c != text_col]
        found, finish = _first_record_columns(text_col, npat, gpat)
        return pages.select(*keep, found).select(*keep, *finish)
    blocks = split_blocks(pages, text_col)
    keep = [c for c in blocks.columns if c != "block"]
    field = F.lit(field_pattern(label, tuple(params.guardian_labels)))
    found = F.arrays_zip(
        F.regexp_extract_all("block", field, F.lit(1)).alias("label"), F.regexp_extract_all("block", field, F.lit(2)).alias("value")
    )
    fields = blocks.select(*keep, found.alias("fields")).select(*keep, "fields", F.posexplode("fields").alias("at", "name"))
    is_name = F.col("name.label") == label
    after = F.get("fields", F.col("at") + 1)
    first = F.get("fields", F.lit(0))
    earlier = F.filter(F.slice("fields", F.lit(1), F.col("at")), lambda f: f["label"] == label)
    guardian = F.when(after["label"] != label, after).when((F.size(earlier) == 0) & (F.col("at") > 0), first)
    paired = fields.where(is_name).select(*keep, F.size(earlier).alias("record_pos"), F.col("name.value").alias("n"), guardian.alias("g"))
    return paired.where(F.col("g").isNotNull()).select(
        *keep,
        "record_pos",
        py_strip("n").alias("name"),
        py_strip("g.value").alias("father"),
        F.col("g.label").alias("relation"),
    )
