"""Plan checks over every registered driver query (sf0.001)."""

import pytest

import __spark_entry__ as entry
from rollscan.operators.filters import cap_pages
from rollscan.plans import rolls

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_product(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = _plan(df)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # only Arrow-batched Python


def test_every_query_has_an_oracle():
    own = entry._queries_raw()
    # at threshold 66 over all words SQL is too slow; test_fuzzy_join holds that query against brute force
    assert set(own) <= set(entry.queries()) and set(own) - {"fuzzy_words_t66"} == set(entry._oracle_raw())


def test_page_cap_pushed_to_scan(spark, tmp_path):
    pages = rolls.roll_pages(spark, SF)
    pages.write.parquet(str(tmp_path / "pages"))
    plan = _plan(cap_pages(spark.read.parquet(str(tmp_path / "pages")), 3).select("path"))
    assert "PushedFilters: [IsNotNull(page), LessThanOrEqual(page,3)]" in plan
    assert "ReadSchema: struct<path:string,page:int>" in plan


def test_scoring_is_native_and_runs_after_the_bounds(spark):
    from rollscan.operators.extract import extract_records
    from rollscan.operators.fuzzy_join import match_pairs

    recs = extract_records(rolls.roll_pages(spark, SF))
    plan = _plan(match_pairs(recs, rolls.roll_queries(spark, SF), 82, "broadcast"))
    join = next(line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    assert "Python" not in plan and "bit_count" in join and "levenshtein" in join
    assert join.index("bit_count") < join.index("levenshtein")  # the cheaper bound first


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["file", "page", "name", "father"]
    assert df.count() > 0
