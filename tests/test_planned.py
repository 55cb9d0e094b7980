"""Planned reads (S1 + T1): bins, plans without bytes, known hashes, errors of single files; total order and JSON parts."""

import glob
import hashlib
import json
import os
import random
import tempfile

import duckdb
from pyspark.sql import functions as F

from rollscan.operators.ordering import total_order
from rollscan.operators.views import positioned
from rollscan.params import SearchParams
from rollscan.sinks.results import write_json
from rollscan.sources.files import scan_pdf_files
from rollscan.sources.ocr import PageError, error_rows, ocr_pages, page_rows
from rollscan.sources.planned import KnownHashes, file_sizes, known_files, number_of_bins, plan_bins, read_files, read_planned, split_uri


def folder(files):
    root = tempfile.mkdtemp(prefix="rollscan-planned-")
    for name, content in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(content)
    return root


def pages(path, content):
    for p in content.decode("utf-8").split("\n", 1)[1].split("\f"):
        if p == "boom":
            raise RuntimeError("engine missing")
        yield PageError("unreadable") if p == "??" else p


def test_many_files_over_all_tasks_without_their_bytes(spark):
    root = folder({f"d{i % 5}/f é%20 {i:04d}.pdf": b"%PDF-1\n" + b"x" * (100_000 if i % 9 else 100) for i in range(320)})
    files = file_sizes(scan_pdf_files(spark, root))
    out = read_planned(files, lambda path, content: [str(len(content))])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "content" not in plan and "Exchange" not in plan
    done = out.where("level = 'read'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    cores = spark.sparkContext.defaultParallelism
    assert len(done) == 4 * cores and max(r["n"] for r in done) <= -(-320 // (4 * cores))
    assert out.where("level is null").count() == 320


def test_rows_equal_those_of_binary_files(spark):
    root = folder({"a.pdf": b"%PDF-1\none\f??\ftwo", "b.pdf": b"%PDF-1\none\fboom", "c.PDF": b"no pdf", "big.pdf": b"%PDF-1\n" + b"x" * 3000, "n.txt": b"%PDF-1\n"})
    params = SearchParams(max_pdf_size_mb=0.002, max_pdf_pages=2)
    files = scan_pdf_files(spark, root)
    out = read_planned(file_sizes(files), pages, params)
    same = lambda d: sorted(map(str, d.select("path", "file", "page", "text", "level", "message").collect()))
    assert same(out.where("level is null or level <> 'read'")) == same(ocr_pages(files, pages, params))
    assert [(r["path"][-5:], r["file_hash"]) for r in read_files(out).collect()] == [("a.pdf", hashlib.sha256(b"%PDF-1\none\f??\ftwo").hexdigest())]
    gone = files.select(F.concat("path", F.lit(".gone")).alias("path"), "length")
    assert error_rows(read_planned(gone, pages)).where("message like '%cannot be read%'").count() == 4
    assert read_planned(files.limit(0), pages).count() == 0


def test_known_files_are_read_but_not_searched(spark):
    bodies = {f"{i}.pdf": b"%PDF-1\npage " + str(i).encode() for i in range(40)}
    files = file_sizes(scan_pdf_files(spark, folder(bodies)))
    hashes = spark.createDataFrame([(hashlib.sha256(bodies[f"{i}.pdf"]).hexdigest(),) for i in range(25)] * 2, "file_hash string")
    for known in (KnownHashes.of(hashes), KnownHashes.of(hashes, exact=5, bits=1 << 12)):
        out = read_planned(files, pages, known=known)
        found = {r["file"] for r in known_files(out).collect()}
        assert found >= {f"{i}.pdf" for i in range(25)} and len(found) <= 30  # the filter may take a few more for known
        assert page_rows(out).count() == 40 - len(found)
    assert known.words is not None and KnownHashes.of(hashes.limit(0)).may_hold("0" * 64) is False


def test_bins_are_even(spark):
    rng = random.Random(1)
    rows = [(f"f{i}", int(rng.paretovariate(1.2) * 100_000)) for i in range(2000)]
    load = plan_bins(spark.createDataFrame(rows, "path string, length long"), 40).groupBy("bin").agg(F.sum("est_pages").alias("p"), F.count("*").alias("n")).collect()
    assert len(load) == 40 and {r["n"] for r in load} == {50}
    longest = max(-(-n // 100_000) for _, n in rows)
    assert max(r["p"] for r in load) <= sum(r["p"] for r in load) / 40 + longest
    assert number_of_bins(3, 10_000, 8) == 3 and number_of_bins(10**9, 10**10, 8) == 100_000 and number_of_bins(0, 0, 8) == 1


def test_paths():
    assert split_uri("/a b/c.pdf") == ("", "", "/a b/c.pdf") and split_uri("file:/a%20b") == ("", "", "/a%20b") and split_uri("file:///x y") == ("", "", "/x y")
    assert split_uri("hdfs://host:8020/d/é.pdf") == ("hdfs", "host:8020", "/d/é.pdf") and split_uri("s3://b/k:1") == ("s3", "b", "/k:1")


def test_total_order_of_hot_keys(spark):
    rows = [(None, 1, "a")] + [("hot", 1, f"n{i}") for i in range(3000)] + [(f"p{i:04}", i % 3, "x") for i in range(500)]
    d = spark.createDataFrame(rows, "path string, page int, name string").repartition(7)
    out = total_order(d, "path", "page", parts=6)
    placed = sorted((r["result_pos"], r["path"], r["page"]) for r in out.collect())
    assert [p for p, *_ in placed] == list(range(1, len(rows) + 1))
    assert [(a or "", b) for _, a, b in placed] == sorted((a or "", b) for a, b, _ in rows)
    assert positioned(d.limit(0)).count() == 0


def test_parts_of_a_json_array(spark):
    rows = [(f"f{i % 7}", i % 5, f"näme \"{i}\"\n") for i in range(1000)]
    d = spark.createDataFrame(rows, "file string, page int, name string")
    out = tempfile.mkdtemp(prefix="rollscan-json-") + "/r.json"
    write_json(d, out, json_array=True, parts=5)
    parts = [p for p in sorted(glob.glob(f"{out}/part-*")) if os.path.getsize(p)]
    assert len(parts) == 5
    whole = "".join(open(p, encoding="utf-8").read() for p in parts)
    assert sorted((r["file"], r["page"], r["name"]) for r in json.loads(whole)) == sorted(rows)
    with open(f"{out}.one", "w", encoding="utf-8") as f:
        f.write(whole)
    con = duckdb.connect()
    assert con.execute("SELECT count(*), count(DISTINCT name) FROM read_json(?, format='array')", [f"{out}.one"]).fetchall() == [(1000, 1000)]
