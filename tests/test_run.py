"""End-to-end run: scan, validate, ledger, page function, search, results, stats."""

import datetime as dt

from pyspark.sql import functions as F
import json
import os
import tempfile

from rollscan.params import SearchParams
from rollscan.plans.run import run_search
from rollscan.sources.names import names_from_list
from rollscan.sources.ocr import PageError

NOW = dt.datetime(2026, 3, 1)


def page_fn(path, content):
    text = content.decode("utf-8").split("\n", 1)[1]
    for page in text.split("\f"):
        yield PageError("unreadable") if page.startswith("??") else page


def box_page_fn(path, content):
    for i, page in enumerate(page_fn(path, content)):
        if isinstance(page, Exception):
            yield page
            continue
        words = []
        for b, block in enumerate(page.split("\n\n")):
            for ln, line in enumerate(block.split("\n")):
                for k, tok in enumerate(line.split()):
                    words.append(dict(word_pos=len(words), block_num=b, par_num=1, line_num=ln, text=tok,
                                      confidence=90.0, bbox=dict(left=10 * k, top=20 * ln, width=8, height=12)))
        yield words


def _setup():
    root = tempfile.mkdtemp(prefix="rollscan-run-")
    pdfs = os.path.join(root, "pdfs")
    os.makedirs(os.path.join(pdfs, "sub"))
    page1 = "নাম : রহিম আলী\nপিতার নাম : করিম আলী\n\nনাম : ফাতিমা খাতুন\nস্বামীর নাম : রহিম আলী"
    page2 = "নাম : রহীম আলী\nপিতার নাম : করিম"
    files = {
        "a.pdf": "%PDF-1.4\n" + page1 + "\f" + "??\f" + page2,
        "sub/b.PDF": "%PDF-1.4\n" + page2,
        "bad.pdf": "NOT A PDF",
    }
    for name, text in files.items():
        with open(os.path.join(pdfs, name), "w", encoding="utf-8") as f:
            f.write(text)
    return root, pdfs


def test_text_run_with_ledger(spark):
    root, pdfs = _setup()
    queries = names_from_list(spark, ["রহিম আলী", "ফাতিমা খাতুন"])
    params = SearchParams(threshold=82)
    out = run_search(spark, pdfs, queries, page_fn, params, ledger_root=os.path.join(root, "ledger"),
                     output_path=os.path.join(root, "out.json"), now=NOW)
    rows = sorted(tuple(r) for r in out.results.collect())
    # রহীম আলী vs রহিম আলী: LCS 6 of 14 characters → 85.7 >= 82
    assert rows == sorted([
        ("a.pdf", 1, "রহিম আলী", "করিম আলী"),
        ("a.pdf", 1, "ফাতিমা খাতুন", "রহিম আলী"),
        ("a.pdf", 3, "রহীম আলী", "করিম"),
        ("b.PDF", 1, "রহীম আলী", "করিম"),
    ])
    s = out.stats.first()
    assert (s.files_processed, s.files_failed, s.pages_processed, s.matches_found) == (2, 1, 3, 4)
    assert out.error_summary.first().error_count == 2
    lines = [json.loads(l) for d, _, fs in os.walk(os.path.join(root, "out.json")) for f in fs if f.endswith(".json")
             for l in open(os.path.join(d, f), encoding="utf-8")]
    assert len(lines) == 4

    # second run: both valid files come from the ledger, nothing is OCR'd again
    def no_ocr(path, content):
        raise AssertionError("ledger hit expected")
        yield  # pragma: no cover

    again = run_search(spark, pdfs, queries, no_ocr, params, ledger_root=os.path.join(root, "ledger"), now=NOW)
    assert sorted(tuple(r) for r in again.results.collect()) == rows
    s2 = again.stats.first()
    assert (s2.files_processed, s2.files_failed, s2.pages_processed) == (2, 1, 0)


def test_box_run(spark):
    root, pdfs = _setup()
    queries = names_from_list(spark, ["রহিম আলী"])
    params = SearchParams(threshold=82, box_level=True, layout="lines")
    out = run_search(spark, pdfs, queries, box_page_fn, params, now=NOW)
    rows = out.results.collect()
    got = {(r.file, r.page, r.name): r for r in rows}
    assert set(got) == {("a.pdf", 1, "রহিম আলী"), ("a.pdf", 3, "রহীম আলী"), ("b.PDF", 1, "রহীম আলী")}
    first = got[("a.pdf", 1, "রহিম আলী")]
    assert first.confidence == 90.0 and first.bbox.left == 20 and first.bbox.width == 18


def test_page_text_from_arrays_equals_regrouped(spark):
    from rollscan.operators.boxes import page_texts, page_texts_from_arrays
    from rollscan.plans import rolls

    words = rolls.roll_words(spark, "/root/testdata/sf0.001")
    arrays = words.groupBy("path", "page").agg(
        F.collect_list(F.struct("word_pos", "block_num", "par_num", "line_num", "text", "confidence", "bbox")).alias("words")
    )
    for layout in ("flat", "lines"):
        p = SearchParams(layout=layout)
        a = sorted(tuple(r) for r in page_texts(words, p).collect())
        b = sorted(tuple(r) for r in page_texts_from_arrays(arrays, p).collect())
        assert a == b and len(a) > 0


def test_cli_search(spark):
    from rollscan.cli import main

    root, pdfs = _setup()
    names = os.path.join(root, "names.txt")
    with open(names, "w", encoding="utf-8") as f:
        f.write("রহিম আলী\n")
    out = os.path.join(root, "res.csv")
    assert main(["search", pdfs, "-n", names, "--page-fn", "test_run:page_fn", "-o", out,
                 "--ledger", os.path.join(root, "ledger")], spark=spark) == 0
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in os.listdir(out) if f.endswith(".csv"))
    assert text.startswith("file,page,name,father") and text.count("রহীম আলী") == 2


def test_box_run_reuses_ledger_with_boxes(spark):
    root, pdfs = _setup()
    queries = names_from_list(spark, ["রহিম আলী"])
    params = SearchParams(threshold=82, box_level=True, layout="lines")
    ledger = os.path.join(root, "ledger")
    first = run_search(spark, pdfs, queries, box_page_fn, params, ledger_root=ledger, now=NOW)
    rows = sorted(map(str, first.results.collect()))

    def no_ocr(path, content):
        raise AssertionError("ledger hit expected")
        yield  # pragma: no cover

    again = run_search(spark, pdfs, queries, no_ocr, params, ledger_root=ledger, now=NOW)
    assert sorted(map(str, again.results.collect())) == rows and len(rows) == 3


def test_ledger_runs_of_other_settings_do_not_share_rows(spark):
    root, pdfs = _setup()
    ledger = os.path.join(root, "ledger2")
    run = lambda **p: sorted(
        tuple(r) for r in run_search(spark, pdfs, names_from_list(spark, ["রহিম আলী"]), page_fn, SearchParams(**p), ledger_root=ledger, now=NOW).results.collect()
    )
    fresh = lambda **p: sorted(
        tuple(r) for r in run_search(spark, pdfs, names_from_list(spark, ["রহিম আলী"]), page_fn, SearchParams(**p), now=NOW).results.collect()
    )
    for p in (dict(max_pdf_pages=1), dict(), dict(threshold=100), dict(strict_labels=True)):
        want = fresh(**p)
        assert run(**p) == want and run(**p) == want, p
    assert fresh(max_pdf_pages=1) != fresh()


def test_run_tables_can_be_dropped(spark):
    _, pdfs = _setup()
    out = run_search(spark, pdfs, names_from_list(spark, ["রহিম আলী"]), page_fn, SearchParams(max_pdf_pages=1), now=NOW)
    assert out.results.count() >= 0 and [r.path.split("/")[-1] for r in out.warnings.collect()] == ["a.pdf"]
    folders = [t.removeprefix("file:") for t in out.tables]
    assert folders and all(map(os.path.exists, folders))
    out.drop()
    assert not any(map(os.path.exists, folders))


def test_cli_refuses_options_that_do_not_fit(spark, capsys):
    from rollscan.cli import main

    assert main(["search", "--pages", "x", "-n", "y", "--box-level", "--ledger", "z"], spark) == 2
    assert "--box-level, --ledger" in capsys.readouterr().err


def test_cli_searches_a_table_of_words(spark):
    from rollscan.cli import main
    from rollscan.plans import rolls

    root = tempfile.mkdtemp(prefix="rollscan-words-")
    words = rolls.roll_words(spark, "/root/testdata/sf0.001")
    words.write.parquet(f"{root}/words")
    name = spark.read.parquet("/root/testdata/sf0.001/part.parquet").first()["p_name"]
    with open(f"{root}/names.txt", "w", encoding="utf-8") as f:
        f.write(name + "\n")
    assert main(["search", "--words", f"{root}/words", "-n", f"{root}/names.txt", "--layout", "lines", "-o", f"{root}/out.csv"], spark=spark) == 0
    text = "".join(open(p, encoding="utf-8").read() for p in (os.path.join(f"{root}/out.csv", n) for n in os.listdir(f"{root}/out.csv")) if p.endswith(".csv"))
    assert text.startswith("file,page,name,father,bbox_left") and name in text
    assert main(["search", "--words", "x", "-n", "y", "--ledger", "z"], spark) == 2


def test_binary_reader_gives_the_same_run(spark):
    root, pdfs = _setup()
    names = names_from_list(spark, ["রহিম আলী", "ফাতিমা খাতুন"])
    runs = {}
    for reader in ("planned", "binary"):
        for turn in (1, 2):
            out = run_search(spark, pdfs, names, page_fn, ledger_root=os.path.join(root, reader), now=NOW, reader=reader)
            runs[reader, turn] = (sorted(map(str, out.results.collect())), sorted(map(str, out.errors.collect())), out.stats.first())
    assert runs["planned", 1] == runs["binary", 1] and runs["planned", 2] == runs["binary", 2]
    assert runs["planned", 1][0] == runs["planned", 2][0] and runs["planned", 2][2]["pages_processed"] == 0


def test_run_on_folder_without_pdfs(spark):
    root = tempfile.mkdtemp(prefix="rollscan-empty-")
    with open(os.path.join(root, "notes.txt"), "w") as f:
        f.write("x")
    out = run_search(spark, root, names_from_list(spark, ["রহিম"]), page_fn, SearchParams(), now=NOW)
    assert out.results.count() == 0
    s = out.stats.first()
    assert (s.files_processed, s.files_failed, s.pages_processed, s.matches_found) == (0, 0, 0, 0)


def test_box_mode_runs_the_patterns_once_per_page(spark, monkeypatch):
    """A flat page is one block as long as the page: its patterns must not run again for every match."""
    import rollscan.plans.search as search

    words = spark.createDataFrame(
        [("p.pdf", 1, i, 0, 1, 0, w, 90.0, (i, 0, 1, 1)) for i, w in enumerate("নাম : রহিম পিতার নাম : করিম".split())],
        "path string, page int, word_pos long, block_num int, par_num int, line_num int, text string, confidence double, "
        "bbox struct<left:int,top:int,width:int,height:int>",
    )
    queries = spark.createDataFrame([("রহিম",), ("করিম",)], "query string")
    seen = []
    joined = search.fuzzy_join
    monkeypatch.setattr(search, "fuzzy_join", lambda records, *rest: seen.append(records) or joined(records, *rest))
    found = search.box_matches(words, queries, SearchParams(box_level=True, layout="flat", threshold=10)).select("page", "query").collect()
    assert sorted(r["query"] for r in found) == ["করিম", "রহিম"]
    assert "regexp" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
