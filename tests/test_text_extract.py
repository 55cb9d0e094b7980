"""N1, strip, X1, X2 golden cases (FIXTURES §2) through the Spark expressions."""

import pytest
from pyspark.sql import functions as F

from rollscan.functions.text import PY_WHITESPACE, normalize_bn, py_split, py_strip
from rollscan.operators.extract import extract_records, split_blocks
from rollscan.params import SearchParams

NL = "\n"


def _one(spark, expr, value):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_whitespace_set_is_python_isspace():
    assert PY_WHITESPACE == "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


@pytest.mark.parametrize(
    "raw,want",
    [
        ("", ""),
        (None, ""),
        ("নামঃ রহিম", "নামরহিম"),
        ("নামঃ র্হিম।", "নামরহিম"),
        ("নাম : রহিম", "নাম:রহিম"),
        ("রহিম করিম", "রহিমকরিম"),
        (" \tরহিম আলী\x1c", "রহিম আলী"),
    ],
)
def test_normalize(spark, raw, want):
    assert _one(spark, normalize_bn, raw) == want


def test_strip_and_split_match_python(spark):
    samples = [" a b ", "\x85a　b\x1f", "\t\n", "a​b", "x\x0b\x0cy "]
    df = spark.createDataFrame([(s,) for s in samples], "x string")
    rows = df.select(py_strip("x").alias("s"), py_split("x").alias("t")).collect()
    for s, r in zip(samples, rows):
        assert r["s"] == s.strip()
        assert list(r["t"]) == s.split()


def _records(spark, text, **kw):
    pages = spark.createDataFrame([("/r/a.pdf", "a.pdf", 1, text)], "path string, file string, page int, text string")
    return [(r.name, r.father) for r in extract_records(pages, SearchParams(**kw)).orderBy("block_pos").collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        (NL + "নাম : রহিম আলী" + NL + "পিতার নাম : করিম আলী" + NL, [("রহিম আলী", "করিম আলী")]),
        (NL + "নাম : ফাতিমা খাতুন" + NL + "স্বামীর নাম : রহিম আলী" + NL, [("ফাতিমা খাতুন", "রহিম আলী")]),
        ("", []),
        ("পিতার নাম : করিম" + NL + "নাম : রহিম", [("করিম", "করিম")]),
        ("নাম :" + NL + "পিতার নাম : করিম", [("পিতার নাম : করিম", "করিম")]),
        ("নাম : রহিম পিতার নাম : করিম", [("রহিম পিতার নাম : করিম", "করিম")]),
        ("নাম:" + "ক" * 200 + NL + "পিতার নাম:খ", [("ক" * 200, "খ")]),
        ("নাম:" + "ক" * 201 + NL + "পিতার নাম:খ", [("খ", "খ")]),
        ("নাম ： ক\r" + NL + "স্বামীর নাম: খ", [("ক", "খ")]),
        ("নাম: ক\x85খ গ" + NL + "পিতার নাম:\x1cখ", [("ক\x85খ গ", "খ")]),
        ("নাম: " + NL + "পিতার নাম: ", [("পিতার নাম:", "")]),
        ("নাম : ক" + NL + "পিতার নাম : খ" + NL * 2 + "নাম : গ", [("ক", "খ")]),
    ],
)
def test_extract_golden(spark, text, want):
    assert _records(spark, text) == want


def test_strict_labels(spark):
    assert _records(spark, "পিতার নাম : করিম" + NL + "নাম : রহিম", strict_labels=True) == [("রহিম", "করিম")]


def test_all_records(spark):
    text = "নাম : ক" + NL + "পিতার নাম : খ" + NL + "নাম : গ" + NL + "স্বামীর নাম : ঘ"
    assert _records(spark, text) == [("ক", "খ")]
    assert _records(spark, text, all_records=True) == [("ক", "খ"), ("গ", "ঘ")]
    name, father = "নাম : ", "পিতার নাম : "
    lines = lambda *x: NL.join(x)
    # a name takes the guardian before the next name, the first name also the one that opens the block
    assert _records(spark, lines(name + "A", name + "B", father + "b"), all_records=True) == [("B", "b")]
    assert _records(spark, lines(father + "b", name + "A"), all_records=True) == [("A", "b")]
    assert _records(spark, lines(father + "x", name + "A", father + "a", name + "B"), all_records=True) == [("A", "a")]
    assert _records(spark, lines(name + "A", father + "a", father + "c", name + "B", father + "b"), all_records=True) == [("A", "a"), ("B", "b")]
    assert _records(spark, lines(father + "x", father + "y"), all_records=True) == []


def test_labels_are_parameters(spark):
    text = "Name (full): A" + NL + "Father: B"
    labels = dict(name_label="Name (full)", guardian_labels=("Father", "Husband"))
    assert _records(spark, text) == []
    assert _records(spark, text, **labels) == [("A", "B")] == _records(spark, text, all_records=True, **labels)


def test_block_split_like_python(spark):
    text = "a\n\n\nb\n\n"
    pages = spark.createDataFrame([("p", "f", 1, text)], "path string, file string, page int, text string")
    got = [r.block for r in split_blocks(pages).orderBy("block_pos").collect()]
    assert got == text.split("\n\n")
