"""Search over streams of page texts or files against a static name list.

Record extraction is per row and the broadcast fuzzy join is a stream-static
join (no distinct step, no state), so ``stream_search`` runs the text-mode
search on ``readStream`` input while the name list passes the broadcast check.
``start_search_stream`` runs the batch search on every micro-batch, for lists
of any size and with one layout of its output.

On a stream of files, ``new_files`` is the ledger's lookup: state by content
hash, kept for the TTL, lets a re-delivered file through only once it expired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rollscan.functions.text import MAX_FIELD_CHARS
from rollscan.operators.fuzzy_join import choose_strategy
from rollscan.params import SearchParams
from rollscan.operators.extract import extract_records
from rollscan.operators.filters import cap_pages
from rollscan.operators.fuzzy_join import fuzzy_join
from rollscan.operators.views import result_view
from rollscan.schemas import PAGES
from rollscan.plans.search import search_text
from rollscan.session import checkpoint_dir, drop_tables, materialize, ship_package, table_scope
from rollscan.sources.files import content_hash
from rollscan.sources.ocr import PageFn, page_rows
from rollscan.sources.planned import read_planned


def stream_matches(pages: DataFrame, queries: DataFrame, params: SearchParams | None = None) -> DataFrame:
    """Detail rows of a streaming text search (``pages`` is a streaming DataFrame)."""
    params = params or SearchParams()
    if choose_strategy(queries, params, max_len=MAX_FIELD_CHARS) != "broadcast":
        raise ValueError("this name list is too large for a single streaming plan: use start_search_stream")
    params = params.with_(strategy="broadcast")
    records = extract_records(cap_pages(pages, params.max_pdf_pages), params)
    return fuzzy_join(records, queries, params, dedupe=False)


def stream_search(pages: DataFrame, queries: DataFrame, params: SearchParams | None = None) -> DataFrame:
    """Result rows ``(file, page, name, father)`` of a streaming text search."""
    return result_view(stream_matches(pages, queries, params), box_level=False)


def _start(rows: DataFrame, name: str, write, available_now: bool) -> StreamingQuery:
    """Run ``write(batch, number)`` on every micro-batch; the checkpoint lives in the session's shared folder."""
    checkpoint = f"{checkpoint_dir(rows.sparkSession).rstrip('/')}/{name}"
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _append_batch(results: DataFrame, output_dir: str, number: int) -> None:
    """A micro-batch's rows as the partition ``batch=N``, overwritten if the batch runs again: no row twice."""
    results.write.mode("overwrite").parquet(f"{output_dir}/batch={number}")


def start_search_stream(
    spark: SparkSession,
    pages_dir: str,
    queries: DataFrame,
    output_dir: str,
    params: SearchParams | None = None,
    name: str = "rollscan_search",
    available_now: bool = True,
) -> StreamingQuery:
    """Search every new page file under ``pages_dir`` (Parquet) and append results as Parquet.

    Results are partitioned by ``batch``, whatever the length of the name
    list; a restarted job resumes where it stopped and overwrites the batch
    that it had not finished.  Each micro-batch is searched by the batch plan,
    which broadcasts the names if they pass the check and shuffles beyond it.
    """
    params = params or SearchParams()
    ship_package(spark)

    def search(batch: DataFrame, number: int) -> None:
        with table_scope() as written:
            _append_batch(search_text(batch, queries, params), output_dir, number)
        drop_tables(spark, written)

    return _start(spark.readStream.schema(PAGES).parquet(pages_dir), name, search, available_now)


# ---------------------------------------------------------------------------
# J3 + F12 on a stream of files
# ---------------------------------------------------------------------------
MICROS_PER_MS = 1000
DAY_MS = 86_400_000


class SeenUntilExpiry(StatefulProcessor):
    """State of one content hash: when a file of that content was last let through.

    A delivery is let through if there is no such time, or if it is older than
    the TTL (F12: an age of exactly the TTL is still valid).  An event-time
    timer drops the state once the watermark has passed that age, so only hashes
    of the last TTL are held.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - the interface's names
        deliveries = sorted(((r["ts_ms"], r["path"], r["length"]) for r in rows), key=str)
        deliveries.sort(key=lambda d: d[0])
        last = self.last.get()[0] if self.last.exists() else None
        for ms, path, length in deliveries:
            if last is None or ms - last > self.ttl_ms:
                last = ms
                yield Row(file_hash=key[0], path=path, length=length, ts_ms=ms)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.ttl_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
DELIVERY = "file_hash string, path string, length long, ts_ms long"
# How far apart the times of one micro-batch's deliveries may lie; arrival times are in order, so a little does.
ARRIVAL_SPREAD = "1 hour"


def new_files(files: DataFrame, params: SearchParams | None = None) -> DataFrame:
    """Of a stream of ``files(path, length, ts, file_hash)``, the deliveries that are not known content within the TTL.

    ``ts`` is the time of arrival (not of the file's last change: Spark drops
    rows whose event time lies before the watermark).  State is kept by content
    hash: hot content is one key with one small value.
    """
    params = params or SearchParams()
    spark = files.sparkSession
    ship_package(spark)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    ms = F.floor(F.unix_micros("ts") / MICROS_PER_MS).cast("long").alias("ts_ms")
    timed = files.select("file_hash", "path", F.col("length").cast("long").alias("length"), "ts", ms).withWatermark("ts", ARRIVAL_SPREAD)
    return timed.groupBy("file_hash").transformWithState(SeenUntilExpiry(int(params.ttl_days * DAY_MS)), DELIVERY, "append", "EventTime")


def start_file_search_stream(
    spark: SparkSession,
    pdf_dir: str,
    queries: DataFrame,
    page_fn: PageFn,
    output_dir: str,
    params: SearchParams | None = None,
    name: str = "rollscan_files",
    available_now: bool = True,
) -> StreamingQuery:
    """Search every new file under ``pdf_dir`` whose content was not searched within the TTL; results by ``batch``.

    A file's bytes are read to be hashed; only paths and hashes meet the state,
    and what is new is searched by planned reads.
    """
    params = params or SearchParams()
    found = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(pdf_dir)
    fresh = new_files(found.select("path", "length", F.current_timestamp().alias("ts"), content_hash("content").alias("file_hash")), params)

    def search(batch: DataFrame, number: int) -> None:
        with table_scope() as written:
            files = materialize(batch.select("path", "length"))
            pages = materialize(page_rows(read_planned(files, page_fn, params)))
            _append_batch(search_text(pages, queries, params), output_dir, number)
        drop_tables(spark, written)

    return _start(fresh, name, search, available_now)
