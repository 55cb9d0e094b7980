"""S1, F2/F3, S2, S4, T1/E1, K1-K3 with real files in a scratch folder."""

import csv
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from rollscan.operators.views import report_view
from rollscan.params import SearchParams
from rollscan.sinks.results import resolve_format, write_results
from rollscan.sources.files import scan_pdf_files, validate_files
from rollscan.sources.names import load_names, names_from_list
from rollscan.sources.ocr import PageError, error_rows, ocr_pages, page_rows, word_rows
from rollscan.sources.words import read_ocr_tsv


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="rollscan-test-")


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_scan_and_validate(spark, scratch):
    _write(f"{scratch}/a/good.pdf", b"%PDF-1.4\ntest")
    _write(f"{scratch}/a/b/UPPER.PDF", b"%PDF-test")
    _write(f"{scratch}/a/bad.pdf", b"NOT A PDF")
    _write(f"{scratch}/a/notes.txt", b"%PDF-1.4")
    _write(f"{scratch}/big.pdf", b"%PDF-" + b"x" * (1024 * 1024 + 10))
    files = scan_pdf_files(spark, scratch)
    v = validate_files(files, SearchParams(max_pdf_size_mb=1)).select("file", "error").collect()
    got = {r.file: r.error for r in v}
    assert set(got) == {"good.pdf", "UPPER.PDF", "bad.pdf", "big.pdf"}
    assert got["good.pdf"] is None and got["UPPER.PDF"] is None
    assert "not a valid PDF" in got["bad.pdf"]
    assert got["big.pdf"].startswith("PDF file too large: 1.0MB (max: 1MB)")


def test_size_filter_pushed_into_scan(spark, scratch):
    _write(f"{scratch}/x.pdf", b"%PDF-1")
    plan = scan_pdf_files(spark, scratch).where(F.col("length") <= 100).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length" in plan


def test_load_names(spark, scratch):
    _write(f"{scratch}/names.txt", "﻿রহিম\r\n  \nকরিম  \r আলী\n\n".encode())
    names = load_names(spark, f"{scratch}/names.txt", SearchParams(max_search_names=2))
    assert [(r.query_pos, r.query) for r in names.orderBy("query_pos").collect()] == [(1, "রহিম"), (2, "করিম")]
    _write(f"{scratch}/bad/n.txt", b"\xff\xfe\x00")
    with pytest.raises(ValueError, match="UTF-8"):
        load_names(spark, f"{scratch}/bad/n.txt")
    _write(f"{scratch}/empty/n.txt", b"  \n\n")
    with pytest.raises(ValueError, match="No names"):
        load_names(spark, f"{scratch}/empty/n.txt")


def test_ocr_tsv(spark, scratch):
    header = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    rows = [
        "1\t1\t0\t0\t0\t0\t0\t0\t100\t100\t-1\t\n",
        '5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t95.5\tনাম"\n',
        "5\t1\t1\t1\t1\t2\t50\t10\t20\t60\t91\tরহিম\n",
    ]
    _write(f"{scratch}/roll a.pdf.tsv", (header + "".join(rows)).encode())
    w = read_ocr_tsv(spark, f"{scratch}/roll a.pdf.tsv").orderBy("word_pos").collect()
    assert [r.text for r in w] == ['নাম"', "রহিম"]
    assert w[0].path.endswith("/roll a.pdf") and w[0].bbox.left == 10 and w[0].confidence == 95.5


def _page_fn(path, content):
    if b"boom" in content:
        raise RuntimeError("rasteriser failed")
    yield "নাম : রহিম\nপিতার নাম : করিম"
    yield PageError("bad page")
    yield [dict(word_pos=0, block_num=1, par_num=1, line_num=1, text="রহিম", confidence=90.0,
                bbox=dict(left=1, top=2, width=3, height=4))]
    yield "page four"


def test_ocr_pages_isolates_errors(spark, scratch):
    _write(f"{scratch}/o/a.pdf", b"%PDF-1 ok")
    _write(f"{scratch}/o/b.pdf", b"%PDF-1 boom")
    _write(f"{scratch}/o/c.pdf", b"NOPE")
    files = scan_pdf_files(spark, f"{scratch}/o")
    out = ocr_pages(files, _page_fn, SearchParams(max_pdf_pages=3)).cache()
    pages = sorted((r.file, r.page) for r in page_rows(out).select("file", "page").collect())
    assert pages == [("a.pdf", 1)]
    assert [r.text for r in word_rows(out).collect()] == ["রহিম"]
    from rollscan.schemas import ERRORS, WORDS

    assert error_rows(out).schema.fieldNames() == ERRORS.fieldNames()
    assert set(word_rows(out).columns) == set(WORDS.fieldNames())
    errs = sorted((r.path.split("/")[-1], r.page, r.level) for r in error_rows(out).collect())
    assert errs == [("a.pdf", 2, "page"), ("b.pdf", None, "file"), ("c.pdf", None, "file")]


def test_oversize_file_is_an_error_whose_bytes_are_not_read(spark, scratch):
    _write(f"{scratch}/o/a.pdf", b"%PDF-1 ok")
    _write(f"{scratch}/o/big.pdf", b"%PDF-" + b"x" * 300_000)
    limit = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "200000")  # reading the large file would raise
    try:
        out = ocr_pages(scan_pdf_files(spark, f"{scratch}/o"), _page_fn, SearchParams(max_pdf_size_mb=0.1)).collect()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", limit)
    large = [r for r in out if r.path.endswith("big.pdf")]
    assert [(r.level, r.message) for r in large] == [("file", "big.pdf: PDF file too large: 0.3MB (max: 0.1MB)")]
    assert any(r.path.endswith("a.pdf") and r.level is None for r in out)


def _many_pages(path, content):
    yield from ("p1", "p2", "p3")


def test_page_cap_is_reported(spark, scratch):
    from rollscan.sources.ocr import warning_rows

    _write(f"{scratch}/o/a.pdf", b"%PDF-1 ok")
    files = scan_pdf_files(spark, f"{scratch}/o")
    for cap, pages, warned in ((None, 3, 0), (3, 3, 0), (2, 2, 1)):
        out = ocr_pages(files, _many_pages, SearchParams(max_pdf_pages=cap))
        assert (page_rows(out).count(), warning_rows(out).count(), error_rows(out).count()) == (pages, warned, 0)


def test_name_cap_is_reported(spark, scratch):
    _write(f"{scratch}/names.txt", "a\nb\nc\n".encode())
    with pytest.warns(UserWarning, match="first 2 of 3 names"):
        load_names(spark, f"{scratch}/names.txt", SearchParams(max_search_names=2))
    with pytest.warns(UserWarning, match="first 1 of 2 names"):
        names_from_list(spark, ["a", "b"], SearchParams(max_search_names=1))
    assert load_names(spark, f"{scratch}/names.txt").count() == 3


def test_csv_keeps_white_space_and_empty_box_header(spark, scratch):
    rows = spark.createDataFrame([(" a.pdf", 1, "b ", "\tc")], "file string, page int, name string, father string")
    write_results(rows.coalesce(1), f"{scratch}/w.csv")
    text = "".join(open(os.path.join(f"{scratch}/w.csv", f), newline="").read() for f in os.listdir(f"{scratch}/w.csv") if f.endswith(".csv"))
    assert list(csv.reader(text.splitlines())) == [["file", "page", "name", "father"], [" a.pdf", "1", "b ", "\tc"]]
    write_results(_results(spark, box=True).limit(0), f"{scratch}/e.csv")
    text = "".join(open(os.path.join(f"{scratch}/e.csv", f)).read() for f in os.listdir(f"{scratch}/e.csv") if f.endswith(".csv"))
    assert text.strip() == "file,page,name,father"


def test_intermediate_tables_can_be_dropped(spark):
    from rollscan.session import drop_tables, materialize, written_tables

    before = written_tables(spark)
    materialize(spark.range(3))
    new = [t for t in written_tables(spark) if t not in before]
    assert len(new) == 1 and os.path.exists(new[0].removeprefix("file:"))
    drop_tables(spark, new + ["/etc"])
    assert not os.path.exists(new[0].removeprefix("file:")) and written_tables(spark) == before


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from rollscan.session import checkpoint_dir

    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(cluster)


def test_ocr_pages_empty_input(spark):
    files = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    assert ocr_pages(files, _page_fn).count() == 0


def _results(spark, box=False):
    if box:
        return spark.createDataFrame(
            [("a,\"b\".pdf", 1, "রহিম", "করিম", (10, 10, 60, 60), 93.456), ("x.pdf", 2, "ক", "খ", None, None)],
            "file string, page int, name string, father string, "
            "bbox struct<left:int,top:int,width:int,height:int>, confidence double",
        )
    return spark.createDataFrame([("test.pdf", 1, "রহিম", "করিম")], "file string, page int, name string, father string")


def _part(path, ext):
    return [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(ext)]


def test_format_dispatch(spark, scratch):
    assert resolve_format("r.JSON") == "json" and resolve_format("r.csv") == "csv"
    with pytest.raises(ValueError, match="Cannot auto-detect"):
        resolve_format("results.xml")
    with pytest.raises(ValueError, match="Unsupported export format"):
        resolve_format("results.json", "xml")
    assert write_results(_results(spark), f"{scratch}/out.txt", "json", json_array=True) == "json"


def test_json_array_and_lines(spark, scratch):
    write_results(_results(spark), f"{scratch}/r.json", json_array=True)
    whole = lambda at: json.loads("".join(open(p, encoding="utf-8").read() for p in sorted(_part(at, ".txt"))))
    assert whole(f"{scratch}/r.json") == [{"file": "test.pdf", "page": 1, "name": "রহিম", "father": "করিম"}]
    write_results(_results(spark).limit(0), f"{scratch}/e.json", json_array=True)
    assert whole(f"{scratch}/e.json") == []
    write_results(_results(spark, box=True), f"{scratch}/b.json")
    lines = [json.loads(l) for p in _part(f"{scratch}/b.json", ".json") for l in open(p, encoding="utf-8")]
    assert {"bbox": None, "confidence": None} .items() <= next(l for l in lines if l["file"] == "x.pdf").items()


def test_csv(spark, scratch):
    write_results(_results(spark, box=True).coalesce(1), f"{scratch}/r.csv")
    (part,) = _part(f"{scratch}/r.csv", ".csv")
    raw = open(part, encoding="utf-8", newline="").read()
    assert raw.startswith("file,page,name,father,bbox_left,bbox_top,bbox_width,bbox_height,confidence\r\n")
    rows = list(csv.DictReader(open(part, encoding="utf-8", newline="")))
    assert rows[0]["file"] == 'a,"b".pdf' and rows[0]["confidence"] == "93.46" and rows[0]["bbox_width"] == "60"
    assert rows[1]["bbox_left"] == "" and rows[1]["confidence"] == ""
    write_results(_results(spark).limit(0), f"{scratch}/e.csv")
    text = "".join(open(p, encoding="utf-8").read() for p in _part(f"{scratch}/e.csv", ".csv"))
    assert "file,page,name,father" in text


def test_report_view(spark):
    rows = report_view(_results(spark, box=True)).collect()
    assert rows[0]["Confidence"] == "93.5%" and rows[1]["Confidence"] == "N/A"


def test_names_from_list(spark):
    from rollscan.schemas import QUERIES

    q = names_from_list(spark, ["  a ", "", "b"])
    assert set(QUERIES.fieldNames()) <= set(q.columns)
    assert [(r.query_pos, r.query) for r in q.orderBy("query_pos").collect()] == [(1, "a"), (2, "b")]


def test_rows_of_small_files_share_a_batch():
    """One batch for each file costs more than its pages: batches are bounded by rows and characters, and hold every row in order."""
    from rollscan.sources import ocr

    row = lambda f, p, text: ocr._err(f"/d/{f}", str(f), p, None, None) | {"text": text}
    small = [[row(f, p, "x" * 10) for p in range(f % 3)] for f in range(10_000)]
    batches = list(ocr.row_batches(iter(small), ocr.OCR_OUT))
    assert len(batches) == -(-sum(map(len, small)) // ocr.BATCH_ROWS)
    assert [r for b in batches for r in b.to_pylist()] == [r for rows in small for r in rows]
    # long pages are handed on before the next file is asked for
    asked = []
    long = ([asked.append(f) or row(f, 1, "y" * ocr.BATCH_CHARS)] for f in range(3))
    assert [(b.num_rows, list(asked)) for b in ocr.row_batches(long, ocr.OCR_OUT)] == [(1, [0]), (1, [0, 1]), (1, [0, 1, 2])]
    assert list(ocr.row_batches(iter([[], []]), ocr.OCR_OUT)) == []
