"""The search as one lazy DataFrame plan.

text mode:  pages → F5 page cap → X1/X2 records → J1 fuzzy join → P2
box mode:   words → F6 → A4 page text → X2 → J1 → J2/W1/A8/A2/A3 → P2

Matching runs before the box lookup (boxes never change which records
match), so word lookup only runs for matched records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rollscan.operators.boxes import locate_records, page_texts
from rollscan.operators.extract import extract_records
from rollscan.operators.filters import cap_pages
from rollscan.operators.fuzzy_join import fuzzy_join
from rollscan.operators.views import result_view
from rollscan.params import SearchParams
from rollscan.session import estimated_bytes, materialize


def _materialize(source: DataFrame, params: SearchParams) -> bool:
    if params.materialize_records is not None:
        return bool(params.materialize_records)
    return estimated_bytes(source) >= params.materialize_min_bytes


def text_matches(pages: DataFrame, queries: DataFrame, params: SearchParams | None = None) -> DataFrame:
    """Detail rows of a text-mode search: record keys, name, father, relation, query, score."""
    params = params or SearchParams()
    records = extract_records(cap_pages(pages, params.max_pdf_pages), params)
    if _materialize(pages, params):
        records = materialize(records)
    return fuzzy_join(records, queries, params)


def search_text(pages: DataFrame, queries: DataFrame, params: SearchParams | None = None) -> DataFrame:
    """Text-mode result rows ``(file, page, name, father)``."""
    return result_view(text_matches(pages, queries, params), box_level=False)


def box_matches(
    words: DataFrame, queries: DataFrame, params: SearchParams | None = None, pages: DataFrame | None = None
) -> DataFrame:
    """Detail rows of a box-mode search (records with name box and mean confidence).

    ``pages``: page texts already built from the words (e.g. from the OCR
    step's word arrays); otherwise they are rebuilt from the word rows.
    """
    params = params or SearchParams(box_level=True)
    words = cap_pages(words, params.max_pdf_pages)
    pages = cap_pages(pages, params.max_pdf_pages) if pages is not None else page_texts(words, params)
    records = extract_records(pages, params)
    # Whatever the size: the words of every page were regrouped for them, and the fields' patterns
    # run over whole pages must not run again for every match.
    if params.materialize_records is not False:
        records = materialize(records)
    matched = fuzzy_join(records, queries, params)
    return locate_records(matched, words, params)


def search_boxes(words: DataFrame, queries: DataFrame, params: SearchParams | None = None) -> DataFrame:
    """Box-mode result rows ``(file, page, name, father, bbox, confidence)``."""
    return result_view(box_matches(words, queries, params), box_level=True)
