"""The whole search run (the reference's ``search`` command) as one Spark job graph.

S1 list → plan → one read per file: F2/F3 validate, P5 hash, J3 known files put
aside, T1 page function (OCR) → text or box search → U1 union with ledger hits
→ K1/K2 results, K4 ledger entries, A1 statistics, E1 errors.

With ``reader="planned"`` (default) tasks open the files themselves
(``sources.planned``): a missed file is hashed and searched in the same read.
With ``reader="binary"``, for stores that only Spark reaches, files come as
``binaryFile`` rows, once to be hashed and, if missed, once to be searched.

Intermediate tables are written once to the shared checkpoint folder where
they are used more than once (the OCR output, the fresh results), so a lost
executor never re-runs OCR of finished files and the lineage stays short.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.operators.boxes import page_texts_from_arrays
from rollscan.operators.stats import error_summary, run_stats
from rollscan.operators.views import result_view
from rollscan.params import SearchParams
from rollscan.plans.search import box_matches, text_matches
from rollscan.session import checkpoint_dir, drop_tables, materialize, ship_package, written_tables
from rollscan.sinks.ledger import Ledger, file_hashes, names_hash, split_hits
from rollscan.sinks.results import resolve_format, write_results
from rollscan.sources.files import fits, scan_pdf_files
from rollscan.sources.ocr import PageFn, error_rows, ocr_pages, page_rows, warning_rows, word_rows
from rollscan.sources.planned import KnownHashes, OpenFile, file_sizes, known_files, open_file, read_files, read_planned


@dataclass
class RunOutput:
    results: DataFrame
    errors: DataFrame
    stats: DataFrame
    error_summary: DataFrame
    # F5's report: files of which only the first pages were searched.
    warnings: DataFrame
    # Intermediate tables behind these results.
    tables: list[str]

    def drop(self) -> None:
        """Delete the run's intermediate tables, once its results have been used."""
        drop_tables(self.results.sparkSession, self.tables)


EMPTY_HITS = (
    "path string, file string, page int, name string, father string, "
    "bbox struct<left:int,top:int,width:int,height:int>, confidence double"
)


def _read_planned(
    files: DataFrame, page_fn: PageFn, params: SearchParams, valid: DataFrame | None, opened: OpenFile
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(page and error rows, result rows of ledger hits, searched files); ``valid`` are the ledger's entries."""
    sizes = file_sizes(files)
    known = KnownHashes.of(valid) if valid is not None else None
    ocr = materialize(read_planned(sizes, page_fn, params, known, opened=opened))
    if valid is None:
        return ocr, None, read_files(ocr)
    hits, wrong = split_hits(known_files(ocr), valid)
    hits, wrong = materialize(hits), materialize(wrong.select("path"))
    if not wrong.isEmpty():  # the filter took them for known; they are read again
        ocr = ocr.unionByName(materialize(read_planned(sizes.join(wrong, "path", "left_semi"), page_fn, params, opened=opened)))
    return ocr, hits, read_files(ocr)


def _read_binary(
    files: DataFrame, page_fn: PageFn, params: SearchParams, ledger: Ledger | None, nhash: str | None, now: dt.datetime
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The same from ``binaryFile`` rows."""
    if ledger is None:
        return materialize(ocr_pages(files, page_fn, params)), None, None
    # Small (path, file_hash) rows, written once: used by the lookup and the append.
    # Files beyond the size limit are errors, never hits, and are not read.
    sized = files.where(fits(params))
    hashes = materialize(file_hashes(sized))
    misses = materialize(ledger.misses(hashes, nhash, now))
    hits, todo = ledger.lookup(sized, nhash, now, hashes)
    hits = materialize(hits)
    ocr = materialize(ocr_pages(todo.unionByName(files.where(~fits(params))), page_fn, params))
    # Searched files = misses without a file-level error (small rows, no file bytes).
    failed = error_rows(ocr).where(F.col("level") == "file").select("path")
    return ocr, hits, misses.join(failed, "path", "left_anti")


def run_search(
    spark: SparkSession,
    pdf_root: str,
    queries: DataFrame,
    page_fn: PageFn,
    params: SearchParams | None = None,
    ledger_root: str | None = None,
    output_path: str | None = None,
    output_format: str = "auto",
    now: dt.datetime | None = None,
    clear_ledger: bool = False,
    reader: str = "planned",
    opened: OpenFile = open_file,
) -> RunOutput:
    """Search every PDF under ``pdf_root`` for ``queries(query_pos, query)``.

    ``page_fn`` is the per-file page function (the OCR engine plug, see
    ``ocr_pages``); it returns texts in text mode and word lists in box mode.
    """
    if reader not in ("planned", "binary"):
        raise ValueError(f"reader must be 'planned' or 'binary', got {reader!r}")
    params = params or SearchParams()
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if output_path:
        resolve_format(output_path, output_format)  # fail before any job runs
    checkpoint_dir(spark)
    ship_package(spark)
    before = set(written_tables(spark))

    files = scan_pdf_files(spark, pdf_root)
    ledger = nhash = None
    if ledger_root:
        ledger = Ledger(spark, ledger_root, params)
        if clear_ledger:
            ledger.clear()
        nhash = names_hash(queries)
    if reader == "planned":
        valid = ledger.valid(nhash, now) if ledger is not None else None
        ocr, hits, done = _read_planned(files, page_fn, params, valid, opened)
    else:
        ocr, hits, done = _read_binary(files, page_fn, params, ledger, nhash, now)
    hits = hits if hits is not None else spark.createDataFrame([], EMPTY_HITS)

    errors = error_rows(ocr)
    if params.box_level:
        searched_pages = ocr.where(F.col("level").isNull() & F.col("words").isNotNull())
        texts = page_texts_from_arrays(searched_pages, params)
        fresh = box_matches(word_rows(ocr), queries, params, pages=texts)
    else:
        searched_pages = page_rows(ocr)
        fresh = text_matches(searched_pages, queries, params)
    fresh = materialize(fresh)

    if ledger is not None:
        ledger.append(done, fresh, nhash, queries.count(), now)

    hit_rows = result_view(hits, params.box_level)
    results = result_view(fresh, params.box_level).unionByName(hit_rows)
    if output_path:
        write_results(results, output_path, output_format)
    stats = run_stats(files, errors, searched_pages, results)
    tables = [t for t in written_tables(spark) if t not in before]
    return RunOutput(results, errors, stats, error_summary(errors), warning_rows(ocr), tables)

