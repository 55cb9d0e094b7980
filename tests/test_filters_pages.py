"""F4 path containment, S3 page readers, O1 order, L1."""

import pytest
from pyspark.sql import functions as F

from rollscan.operators.filters import first_names, normalize_path, pdf_suffix, within_base
from rollscan.operators.views import ordered
from rollscan.params import SearchParams
from rollscan.sources.pages import pages_from_texts, read_pages


@pytest.mark.parametrize(
    "path,inside",
    [
        ("/data/base/a.pdf", True),
        ("/data/base", True),
        ("/data/base2/a.pdf", False),  # sibling with the same prefix
        ("/data/base/../base2/a.pdf", False),
        ("/data/x/../base/./a.pdf", True),
        ("//data//base//a.pdf", True),
        ("/data/base/../../etc/passwd", False),
    ],
)
def test_within_base(spark, path, inside):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(within_base("path", "/data/base/").alias("x")).first()["x"] is inside


def test_normalize_path(spark):
    df = spark.createDataFrame([("/a/./b/../c//d/",), ("/../..",)], "p string")
    assert [r.n for r in df.select(normalize_path(F.col("p")).alias("n")).collect()] == ["/a/c/d", "/"]


def test_pdf_suffix(spark):
    df = spark.createDataFrame([("a.PdF",), ("a.pdf.txt",), ("pdf",)], "path string")
    assert [r.x for r in df.select(pdf_suffix("path").alias("x")).collect()] == [True, False, False]


def test_read_pages_and_cap(spark, tmp_path):
    rows = [("/r/a.pdf", p, f"text {p}") for p in range(1, 6)]
    spark.createDataFrame(rows, "path string, page int, text string").write.parquet(str(tmp_path / "p"))
    got = read_pages(spark, str(tmp_path / "p"), params=SearchParams(max_pdf_pages=3))
    assert sorted((r.file, r.page) for r in got.collect()) == [("a.pdf", 1), ("a.pdf", 2), ("a.pdf", 3)]


def test_pages_from_texts(spark):
    texts = spark.createDataFrame([("/r/b.pdf", "one\ftwo\f\fthree")], "path string, value string")
    got = pages_from_texts(texts).orderBy("page").collect()
    assert [(r.file, r.page, r.text) for r in got] == [("b.pdf", 1, "one"), ("b.pdf", 2, "two"), ("b.pdf", 3, ""), ("b.pdf", 4, "three")]


def test_ordered_and_first_names(spark):
    df = spark.createDataFrame(
        [("/b", 1, 0, 2), ("/a", 2, 1, 1), ("/a", 2, 0, 3), ("/a", 1, 5, 1)],
        "path string, page int, block_pos int, query_pos int",
    )
    assert [tuple(r) for r in ordered(df).collect()] == [("/a", 1, 5, 1), ("/a", 2, 0, 3), ("/a", 2, 1, 1), ("/b", 1, 0, 2)]
    assert first_names(df, 2).count() == 3
