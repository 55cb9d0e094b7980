"""Search plan options and parameter checks."""

import pytest

from rollscan.operators.stats import run_stats
from rollscan.params import SearchParams
from rollscan.plans import rolls
from rollscan.plans.search import search_boxes, search_text

SF = "/root/testdata/sf0.001"


def test_materialized_records_same_result(spark):
    pages, queries = rolls.roll_pages(spark, SF), rolls.roll_queries(spark, SF)
    a = sorted(tuple(r) for r in search_text(pages, queries, SearchParams(materialize_records=True)).collect())
    b = sorted(tuple(r) for r in search_text(pages, queries, SearchParams(materialize_records=False)).collect())
    assert a == b and len(a) > 0


def test_strategies_same_box_result(spark):
    words, queries = rolls.roll_words(spark, SF), rolls.roll_queries(spark, SF)
    p = SearchParams(box_level=True, layout="lines")
    a = sorted(map(str, search_boxes(words, queries, p.with_(strategy="broadcast")).collect()))
    b = sorted(map(str, search_boxes(words, queries, p.with_(strategy="shuffle")).collect()))
    assert a == b and len(a) > 0


@pytest.mark.parametrize(
    "kw",
    [dict(threshold=101), dict(threshold=-1), dict(min_confidence=100.5), dict(layout="grid"),
     dict(strategy="nested"), dict(max_pdf_pages=-1)],
)
def test_params_rejected(kw):
    with pytest.raises(ValueError):
        SearchParams(**kw)


def test_defaults_match_reference():
    p = SearchParams()
    assert (p.threshold, p.min_confidence, p.max_pdf_size_mb, p.max_pdf_pages) == (82, 60.0, 50, None)
    assert (p.max_search_names, p.word_match_threshold, p.ttl_days, p.ledger_version) == (None, 70, 30, "1.0")
    assert p.box_level is False


def test_empty_run_stats_are_zero(spark):
    empty = spark.createDataFrame([], "path string, page int, level string, message string")
    files = spark.createDataFrame([], "path string")
    s = run_stats(files, empty, empty, empty).first()
    assert (s.files_processed, s.files_failed, s.pages_processed, s.matches_found, s.error_count) == (0, 0, 0, 0, 0)
