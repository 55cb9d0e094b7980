"""Stream-static search equals the batch search on the same pages."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from rollscan.params import SearchParams
from rollscan.plans import rolls
from rollscan.plans.search import search_text
from rollscan.schemas import PAGES
from rollscan.streaming.search_stream import new_files, start_file_search_stream, start_search_stream, stream_search

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="rollscan-stream-")
    pages = rolls.roll_pages(spark, SF).select(*[f.name for f in PAGES.fields])
    pages.where(F.col("page") <= 2).write.parquet(os.path.join(root, "in", "b1"))
    pages.where(F.col("page") > 2).write.parquet(os.path.join(root, "in", "b2"))
    queries = rolls.roll_queries(spark, SF)
    params = SearchParams(threshold=82)

    stream = spark.readStream.schema(PAGES).parquet(os.path.join(root, "in", "*"))
    q = stream_search(stream, queries, params).writeStream.format("memory").queryName("roll_matches").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("roll_matches").collect())
    want = sorted(tuple(r) for r in search_text(pages, queries, params).collect())
    assert got == want and len(want) > 0

    sq = start_search_stream(spark, os.path.join(root, "in", "*"), queries, os.path.join(root, "out"), params, name=f"t_{os.path.basename(root)}")
    sq.awaitTermination(300)
    assert spark.read.parquet(os.path.join(root, "out")).count() == len(want)

    # a name list beyond the broadcast check: the batch join on every micro-batch
    large = start_search_stream(
        spark, os.path.join(root, "in", "*"), queries, os.path.join(root, "out2"), params.with_(broadcast_max_queries=1),
        name=f"t2_{os.path.basename(root)}",
    )
    large.awaitTermination(300)
    rows = spark.read.parquet(os.path.join(root, "out2")).select("file", "page", "name", "father").collect()
    assert sorted(tuple(r) for r in rows) == want


def deliveries(spark, folder, rows):
    spark.createDataFrame(rows, "path string, length long, ts timestamp, file_hash string").coalesce(1).write.mode("append").parquet(folder)


def test_redelivered_file_is_skipped_until_it_expires(spark):
    root = tempfile.mkdtemp(prefix="rollscan-ttl-")
    now = dt.datetime.now()
    day = dt.timedelta(days=1)
    schema = "path string, length long, ts timestamp, file_hash string"
    deliveries(spark, f"{root}/in", [("a", 1, now, "h1"), ("b", 2, now, "h2"), ("a2", 1, now, "h1")])
    stream = new_files(spark.readStream.schema(schema).parquet(f"{root}/in"), SearchParams(ttl_days=30))
    q = stream.writeStream.format("memory").queryName("fresh_files").option("checkpointLocation", f"{root}/ckpt").start()
    try:
        seen = lambda: sorted((r.file_hash, r.path) for r in spark.table("fresh_files").collect())
        q.processAllAvailable()
        assert seen() == [("h1", "a"), ("h2", "b")]  # a copy in the same batch is known content
        deliveries(spark, f"{root}/in", [("a", 1, now + 10 * day, "h1"), ("c", 3, now + 10 * day, "h3"), ("a", 1, now + 30 * day, "h1")])
        q.processAllAvailable()
        assert seen() == [("h1", "a"), ("h2", "b"), ("h3", "c")]  # inside, and exactly at, the TTL
        deliveries(spark, f"{root}/in", [("a", 1, now + 30 * day + dt.timedelta(seconds=1), "h1"), ("a", 1, now + 31 * day, "h1")])
        q.processAllAvailable()
        assert seen() == [("h1", "a"), ("h1", "a"), ("h2", "b"), ("h3", "c")]  # once it expired, and then known again
    finally:
        q.stop()


def file_pages(path, content):
    yield from content.decode("utf-8").split("\n", 1)[1].split("\f")


def test_file_stream_searches_new_content_once(spark):
    root = tempfile.mkdtemp(prefix="rollscan-files-")
    os.makedirs(f"{root}/pdfs")
    text = "%PDF-1.4\nনাম : রহিম আলী\nপিতার নাম : করিম"

    def put(name, body):
        with open(f"{root}/pdfs/{name}", "w", encoding="utf-8") as f:
            f.write(body)

    def run():
        start_file_search_stream(spark, f"{root}/pdfs", names, file_pages, f"{root}/out", name=f"f_{os.path.basename(root)}").awaitTermination(300)
        return sorted((r.file, r.name) for r in spark.read.parquet(f"{root}/out").collect())

    names = spark.createDataFrame([(1, "রহিম আলী")], "query_pos int, query string")
    put("a.pdf", text)
    assert run() == [("a.pdf", "রহিম আলী")]
    put("again.pdf", text)  # the same content under another name
    put("b.pdf", text + "\fনাম : রহিম আলি\nপিতার নাম : করিম")
    assert run() == [("a.pdf", "রহিম আলী"), ("b.pdf", "রহিম আলি"), ("b.pdf", "রহিম আলী")]
