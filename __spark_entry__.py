"""

value-hash).  Every query starts from the driver's Parquet tables: roll
pages, OCR words and name lists are laid out from ``part`` by
``rollscan.plans.rolls`` (the same layout in SQL for the oracle), and the
engine's operators run on them unchanged.
"""

from __future__ import annotations

import datetime
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.operators.extract import extract_records, split_blocks
from rollscan.operators.filters import cap_pages, truncated_files
from rollscan.functions.text import normalize_bn
from rollscan.params import SearchParams
from rollscan.plans import rolls
from rollscan.operators.boxes import best_words, page_texts, record_tokens
from rollscan.operators.filters import filter_words
from rollscan.operators.fuzzy_join import fuzzy_join
from rollscan.operators.views import csv_view, positioned, report_view, result_view
from rollscan.functions.text import basename
from rollscan.operators.filters import normalize_path, pdf_suffix, within_base
from rollscan.operators.stats import error_summary, run_stats
from rollscan.plans.run import run_search
from rollscan.plans.search import search_boxes, search_text, text_matches
from rollscan.session import checkpoint_dir, materialize, ship_package
from rollscan.sinks.ledger import (
    Ledger,
    ledger_key,
    names_hash,
    names_hash_expr,
    oldest_valid,
    search_entries,
    split_hits,
    valid_predicate,
)
from rollscan.sources.files import content_hash, scan_pdf_files, size_mb, validate_files
from rollscan.sinks.results import write_json, write_results
from rollscan.sources.names import names_from_texts, truncated_lists
from rollscan.sources.pages import read_pages
from rollscan.sources.ocr import error_rows, ocr_pages, page_rows
from rollscan.sources.planned import file_sizes, read_files, read_planned
from rollscan.sources.words import read_ocr_tsv

try:  # the training-data operators and the pipeline can be taken away as a whole, and need more packages than the rest
    from rollscan.llm import queries as llm_queries
except ImportError as e:
    if e.name != "rollscan.llm":
        warnings.warn(f"training-data queries are left out: {e}", stacklevel=2)
    llm_queries = None


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------
def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolls.roll_pages(spark, sf_dir)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolls.roll_queries(spark, sf_dir)


def q_normalize_names(spark, sf_dir):
    """N1 over every block text of the roll pages."""
    blocks = split_blocks(_pages(spark, sf_dir))
    return blocks.select("path", "page", "block_pos", normalize_bn("block").alias("norm"))


def q_block_split(spark, sf_dir):
    """X1 + W2: blocks with their 0-based position and page number."""
    return split_blocks(_pages(spark, sf_dir)).select(
        "path", "page", "block_pos", F.length("block").alias("block_chars"), "block"
    )


def q_extract_records(spark, sf_dir):
    """X2 + F8 (+ Q1-Q3 as in the reference): one record per block."""
    return extract_records(_pages(spark, sf_dir)).select(
        "path", "file", "page", "block_pos", "name", "father", "relation"
    )


def q_extract_records_strict(spark, sf_dir):
    """X2 with the name label anchored to a line start (Q1 option)."""
    return extract_records(_pages(spark, sf_dir), SearchParams(strict_labels=True)).select(
        "path", "file", "page", "block_pos", "name", "father", "relation"
    )


def q_page_cap(spark, sf_dir):
    """Pages 1..3 of every file."""
    return cap_pages(_pages(spark, sf_dir), 3).select("path", "page", F.length("text").alias("chars"))


def _fuzzy(threshold: int, strategy: str = "auto"):
    def run(spark, sf_dir):
        params = SearchParams(threshold=threshold, strategy=strategy)
        return search_text(_pages(spark, sf_dir), _queries(spark, sf_dir), params)

    run.__doc__ = f"J1 + P2 at threshold {threshold}, {strategy} strategy."
    return run


def q_fuzzy_search_detail(spark, sf_dir):
    """J1 detail: which query matched which record."""
    m = text_matches(_pages(spark, sf_dir), _queries(spark, sf_dir), SearchParams(strategy="auto"))
    return m.select("path", "page", "block_pos", "name", "father", "query")


def _words(spark, sf_dir):
    return rolls.roll_words(spark, sf_dir)


BOX_LINES = SearchParams(box_level=True, layout="lines")
# Flat layout (reference): a page is one block and its "name" runs to the page
# end, so only a low threshold yields matches to compare.
BOX_FLAT = SearchParams(box_level=True, layout="flat", threshold=10)


def q_word_filter(spark, sf_dir):
    """S4 + F6: OCR words kept at confidence >= 60, text stripped."""
    w = filter_words(_words(spark, sf_dir), 60.0)
    return w.select("path", "page", "word_pos", "text", "confidence")


def q_rebuild_text(spark, sf_dir):
    """A4, lines layout: page text rebuilt from the kept words."""
    return page_texts(_words(spark, sf_dir), BOX_LINES).select("path", "file", "page", "text")


def q_rebuild_text_flat(spark, sf_dir):
    """A4, flat layout (reference): all kept words joined by one space."""
    return page_texts(_words(spark, sf_dir), BOX_FLAT).select("path", "file", "page", "text")


def q_best_word(spark, sf_dir):
    """J2 + W1 + F11: best page word per token of every matched record."""
    words = _words(spark, sf_dir)
    recs = extract_records(page_texts(words, BOX_LINES), BOX_LINES)
    matched = fuzzy_join(recs, _queries(spark, sf_dir), BOX_LINES)
    key = ["path", "page", "block_pos"]
    recs = materialize(matched.select(*key, "name", "father").dropDuplicates(key))
    toks = record_tokens(recs, key)
    best = best_words(toks, filter_words(words, 60.0), 70, key)
    return best.select(*key, "field", "tok_pos", "word_pos", "w_text", "w_conf", "w_score")


def _flat_boxes(df):
    cols = ["file", "page", "name", "father"]
    return df.select(
        *cols,
        *[F.col(f"bbox.{k}").alias(f"bbox_{k}") for k in ("left", "top", "width", "height")],
        "confidence",
    )


def q_record_boxes(spark, sf_dir):
    """X3 + A2 + A3 + A8 + P2 (box mode, lines layout): matches with name box and confidence."""
    return _flat_boxes(search_boxes(_words(spark, sf_dir), _queries(spark, sf_dir), BOX_LINES))


def q_record_boxes_flat(spark, sf_dir):
    """Box mode with the reference's flat layout (one block per page, Q4), threshold 10."""
    return _flat_boxes(search_boxes(_words(spark, sf_dir), _queries(spark, sf_dir), BOX_FLAT))


def q_csv_view(spark, sf_dir):
    """CSV columns of box-mode results (bbox flattened, confidence %.2f)."""
    return csv_view(search_boxes(_words(spark, sf_dir), _queries(spark, sf_dir), BOX_LINES))


def q_report_view(spark, sf_dir):
    """K7: console report columns of box-mode results."""
    return report_view(search_boxes(_words(spark, sf_dir), _queries(spark, sf_dir), BOX_LINES))


# -- file-level operators on the document "PDF" files ------------------------
# The size limit is the feature of ``validate_files``, the page cap that of ``page_cap`` and ``truncated_files``.
FILE_PARAMS = SearchParams(max_pdf_size_mb=0.02)


def _files(spark, sf_dir):
    return rolls.doc_files(spark, sf_dir)


def q_path_filter(spark, sf_dir):
    """F1 + F4 + P1: PDF-suffixed files strictly under /data/src1 (after resolving ..)."""
    f = _files(spark, sf_dir)
    kept = f.where(pdf_suffix("path") & within_base("path", "/data/src1"))
    return kept.select("path", basename(F.col("path")).alias("file"), normalize_path(F.col("path")).alias("resolved"))


def q_validate_files(spark, sf_dir):
    """F2 + F3 + P4: first failing check per file (size cap 0.02 MB, then magic number)."""
    v = validate_files(_files(spark, sf_dir).where(pdf_suffix("path")), FILE_PARAMS)
    return v.select("path", "file", "length", size_mb(F.col("length")).alias("size_mb"), "error")


def q_ledger_keys(spark, sf_dir):
    """P6 + P5 + A7: ledger key of every PDF file for the roll name list (threshold 82, text mode)."""
    nhash = names_hash(_queries(spark, sf_dir))
    files = _files(spark, sf_dir).where(pdf_suffix("path"))
    return files.select("path", ledger_key(content_hash("content"), F.lit(nhash), LEDGER_PARAMS).alias("ledger_key"))


def q_extract_records_all(spark, sf_dir):
    """X2 with the all-records option (Q3): every anchored name line pairs with its guardian line."""
    return extract_records(_pages(spark, sf_dir), SearchParams(all_records=True)).select(
        "path", "file", "page", "block_pos", "record_pos", "name", "father", "relation"
    )


def q_report_view_text(spark, sf_dir):
    """K7 in text mode (no Confidence column) over the flagship search."""
    return report_view(search_text(_pages(spark, sf_dir), _queries(spark, sf_dir), SearchParams()))


def q_content_hash(spark, sf_dir):
    """P5 + N6: SHA-256 of every file's bytes."""
    return _files(spark, sf_dir).select("path", content_hash("content").alias("file_hash"))


def q_ocr_pages(spark, sf_dir):
    """T1 + E1 + F3: per-file page function over all pages of the PDF-suffixed files; files that
    are no PDF and failed pages become error rows."""
    files = _files(spark, sf_dir).where(pdf_suffix("path"))
    out = ocr_pages(files, rolls.text_page_fn, SearchParams())
    return out.select("path", "page", "text", "level", "message")


def q_truncated_files(spark, sf_dir):
    """F5's report: files with more than three pages, as warnings."""
    return truncated_files(_pages(spark, sf_dir), 3).select("path", "page", "level", "message")


def q_truncated_lists(spark, sf_dir):
    """L1's report: name lists with more than 300 names, as warnings."""
    texts = rolls.roll_name_files(spark, sf_dir)
    return truncated_lists(texts, SearchParams(max_search_names=300)).select("path", "page", "level", "message")


def q_run_stats(spark, sf_dir):
    """A1 + A6: run statistics, with the first errors, of a text search over the pages of all documents and rolls."""
    out = materialize(rolls.doc_ocr(spark, sf_dir))
    pages = page_rows(out).unionByName(_pages(spark, sf_dir))
    files = out.select("path").distinct().unionByName(_pages(spark, sf_dir).select("path").distinct())
    matches = search_text(pages, _queries(spark, sf_dir), SearchParams())
    return run_stats(files, error_rows(out), pages, matches)


def q_error_summary(spark, sf_dir):
    """A9 + L3 + E1: error count, first 10 errors, "... and N more"."""
    return error_summary(error_rows(rolls.doc_ocr(spark, sf_dir)))


def q_file_scan(spark, sf_dir):
    """S1 + T1 + E1 by planned reads: all documents written as files, listed, and each opened in its task."""
    root = rolls.write_files(rolls.document_pdfs(spark, sf_dir), _round_trip_folder(spark) + "/files")
    out = read_planned(file_sizes(scan_pdf_files(spark, root)), rolls.text_page_fn)
    return out.where("level is null or level <> 'read'").select("file", "page", "text", "level", F.regexp_replace("message", ": [^ ]*/files/", ": /").alias("message"))


def q_file_hashes(spark, sf_dir):
    """S1 + P5 by planned reads: content hash of every valid document file."""
    root = rolls.write_files(rolls.document_pdfs(spark, sf_dir), _round_trip_folder(spark) + "/files")
    return read_files(read_planned(file_sizes(scan_pdf_files(spark, root)), rolls.text_page_fn)).select(
        basename(F.col("path")).alias("file"), "file_hash"
    )


def _two_runs(spark, sf_dir):
    """All rolls written as files and searched by the whole run, twice with one ledger."""
    folder = _round_trip_folder(spark)
    root = rolls.write_files(rolls.roll_pdfs(spark, sf_dir), folder + "/pdfs")
    queries = _queries(spark, sf_dir)
    return [
        run_search(spark, root, queries, rolls.roll_page_fn, SearchParams(), ledger_root=folder + "/ledger", now=LEDGER_NOW)
        for _ in range(2)
    ]


def q_search_run(spark, sf_dir):
    """T2 end to end: results of the run over files and of a second one, which takes them from the ledger."""
    found = [o.results.select(F.lit(i + 1).alias("run"), "file", "page", "name", "father") for i, o in enumerate(_two_runs(spark, sf_dir))]
    return found[0].unionByName(found[1])


def q_search_run_stats(spark, sf_dir):
    """T2 + A1 end to end: statistics of both runs."""
    found = [o.stats.select(F.lit(i + 1).alias("run"), "*").drop("errors") for i, o in enumerate(_two_runs(spark, sf_dir))]
    return found[0].unionByName(found[1])


def q_ocr_words(spark, sf_dir):
    """The OCR engine's TSV files of all rolls, written and read back as word rows."""
    root = rolls.write_files(rolls.word_tsv(spark, sf_dir), _round_trip_folder(spark) + "/tsv")
    w = read_ocr_tsv(spark, root)
    return w.select(
        basename(F.col("path")).alias("file"), "page", "word_pos", "block_num", "par_num", "line_num", "text", "confidence",
        *[F.col(f"bbox.{k}").alias(f"bbox_{k}") for k in ("left", "top", "width", "height")],
    )


def q_result_order(spark, sf_dir):
    """O1: the place of every match in the order by file, page, record and query."""
    m = text_matches(_pages(spark, sf_dir), _queries(spark, sf_dir), SearchParams())
    return positioned(m.select("path", "page", "block_pos", "query", "name"))


def q_json_array_round_trip(spark, sf_dir):
    """K1, array form: results written as the parts of one JSON array and read back line by line; which line opens and closes it."""
    out = _round_trip_folder(spark) + "/results.json"
    m = text_matches(_pages(spark, sf_dir), _queries(spark, sf_dir), SearchParams()).select("path", "page", "block_pos", "query", "name")
    write_json(m, out, json_array=True, parts=4)
    v = spark.read.text(out).where("value <> ''")
    row = F.from_json(F.regexp_replace(F.regexp_replace("value", "^[\\[,]", ""), "\\]$", ""), "path string, page int, block_pos int, query string, name string")
    return v.select(row.alias("r"), F.col("value").startswith("[").alias("opens"), F.col("value").endswith("]").alias("closes")).select("r.*", "opens", "closes")


def q_empty_results(spark, sf_dir):
    """K1 + K2 of a search that finds nothing: the lines of the CSV and of the JSON array."""
    nothing = search_text(_pages(spark, sf_dir), _queries(spark, sf_dir).select(F.lit("\u2603").alias("query")).distinct(), SearchParams())
    out = _round_trip_folder(spark)
    write_results(nothing, out + "/r.csv")
    write_results(nothing, out + "/r.json", json_array=True)
    read = lambda kind: spark.read.text(f"{out}/r.{kind}").select(F.lit(kind).alias("kind"), F.regexp_replace("value", "\r", "").alias("line")).where("line <> ''")
    return read("csv").distinct().unionByName(read("json"))


def _names(spark, sf_dir, most=None):
    return names_from_texts(rolls.roll_name_files(spark, sf_dir), SearchParams(max_search_names=most))


def q_query_list(spark, sf_dir):
    """S2 + F7 + L1: name-list files → stripped, non-blank names, first 300 per file."""
    return _names(spark, sf_dir, 300)


def q_names_hash(spark, sf_dir):
    """A7 + O2 + N6: names hash of every name-list file."""
    return _names(spark, sf_dir).groupBy("path").agg(names_hash_expr(F.col("query")).alias("names_hash"))


LEDGER_PARAMS = SearchParams(threshold=82, box_level=False, min_confidence=60.0)
LEDGER_NOW = datetime.datetime(2026, 1, 1)


def _ledger_inputs(spark, sf_dir):
    nhash = names_hash(_queries(spark, sf_dir))
    files = _files(spark, sf_dir).where(pdf_suffix("path")).withColumn("file_hash", content_hash("content"))
    entries = search_entries(rolls.doc_ledger(spark, sf_dir, nhash), nhash, LEDGER_PARAMS, LEDGER_NOW)
    return files.select("path", "file_hash"), entries


def q_ledger_hits(spark, sf_dir):
    """J3 (inner) + S5 + F12 + F13 + K4 newest-wins: stored rows of files searched before."""
    files, entries = _ledger_inputs(spark, sf_dir)
    hits, _ = split_hits(files, entries)
    return hits.select("path", "file", "page", "name", "father")


def q_ledger_misses(spark, sf_dir):
    """J3 (left anti): files that must be searched in this run."""
    files, entries = _ledger_inputs(spark, sf_dir)
    _, misses = split_hits(files, entries)
    return misses.select("path")


def q_ledger_expire(spark, sf_dir):
    """F12 + F13 over the whole ledger at the fixed now: entries, how many the expiry (K6)
    removes and keeps, and how many are valid; the rewrite itself is ``Ledger.clear_expired``."""
    nhash = names_hash(_queries(spark, sf_dir))
    entries = rolls.doc_ledger(spark, sf_dir, nhash)
    oldest = oldest_valid(LEDGER_NOW, LEDGER_PARAMS)
    return entries.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(F.col("ts") < oldest).alias("expired"),
        F.count_if(F.col("ts") >= oldest).alias("kept"),
        F.count_if(valid_predicate(LEDGER_NOW, LEDGER_PARAMS)).alias("valid"),
    )


def q_ledger_param_change(spark, sf_dir):
    """P6 + J3 over one ledger with two settings of a result-changing parameter (page cap): stored rows by setting."""
    nhash = names_hash(_queries(spark, sf_dir))
    files = _files(spark, sf_dir).where(pdf_suffix("path")).select("path", content_hash("content").alias("file_hash"))
    ledger = rolls.doc_ledger(spark, sf_dir, nhash)
    found = []
    for name, params in (("all pages", LEDGER_PARAMS), ("first 5", LEDGER_PARAMS.with_(max_pdf_pages=5))):
        hits, _ = split_hits(files, search_entries(ledger, nhash, params, LEDGER_NOW))
        found.append(hits.select(F.lit(name).alias("setting"), "path", "page", "name"))
    return found[0].unionByName(found[1])


def _round_trip_folder(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/round-trips/{uuid.uuid4().hex}"


def q_json_round_trip(spark, sf_dir):
    """K1 + K3 + N10: all results written as JSON by suffix and read back."""
    out = _round_trip_folder(spark) + "/results.json"
    write_results(search_text(_pages(spark, sf_dir), _queries(spark, sf_dir), SearchParams()), out)
    return spark.read.schema("file string, page int, name string, father string").json(out)


def q_csv_round_trip(spark, sf_dir):
    """K2 + K3 + P3: all box results written as CSV by suffix and read back as text; names padded by a blank."""
    out = _round_trip_folder(spark) + "/results.csv"
    found = search_boxes(_words(spark, sf_dir), _queries(spark, sf_dir), BOX_LINES)
    write_results(found.withColumn("name", F.concat(F.lit(" "), "name", F.lit(" "))), out)
    read = spark.read.option("header", "true").option("escape", '"').option("lineSep", "\r\n")
    back = read.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(out)
    return back.select([F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


def q_pages_scan(spark, sf_dir):
    """S3: page texts written as a table and read back by the page source."""
    out = _round_trip_folder(spark) + "/pages"
    _pages(spark, sf_dir).select("path", "page", "text").write.parquet(out)
    return read_pages(spark, out)


def q_run_union(spark, sf_dir):
    """U1 + P2: fresh text results and the stored rows of ledger hits as one bag."""
    files, entries = _ledger_inputs(spark, sf_dir)
    hits, _ = split_hits(files, entries)
    fresh = search_text(_pages(spark, sf_dir), _queries(spark, sf_dir), SearchParams())
    return fresh.unionByName(result_view(hits))


def _new_ledger(spark, sf_dir):
    """A ledger of its own folder with one run over the PDF documents: a result row for two files of three."""
    ledger = Ledger(spark, _round_trip_folder(spark) + "/ledger", LEDGER_PARAMS)
    nhash = names_hash(_queries(spark, sf_dir))
    files = _files(spark, sf_dir).where(pdf_suffix("path"))
    hashes = materialize(files.select("path", "doc_id", content_hash("content").alias("file_hash")))
    rows = hashes.where("doc_id % 3 > 0").select(
        "path", basename(F.col("path")).alias("file"), F.lit(1).alias("page"),
        F.concat(F.lit("name "), F.col("doc_id").cast("string")).alias("name"), F.lit("guardian").alias("father"),
    )
    late = hashes.where("doc_id % 4 > 0")
    ledger.append(late, rows, nhash, 1, LEDGER_NOW)
    ledger.append(hashes.where("doc_id % 4 = 0"), rows, nhash, 1, LEDGER_NOW - datetime.timedelta(days=31))
    return ledger, nhash, hashes


def q_ledger_round_trip(spark, sf_dir):
    """K4 + S5 + J3: entries appended to a ledger folder and looked up again; expired ones don't count."""
    ledger, nhash, hashes = _new_ledger(spark, sf_dir)
    hits, todo = ledger.lookup(hashes.select("path"), nhash, LEDGER_NOW, hashes.select("path", "file_hash"))
    found = hits.select("path", "name", F.lit("hit").alias("kind"))
    return found.unionByName(todo.select("path", F.lit(None).cast("string").alias("name"), F.lit("todo").alias("kind")))


def q_ledger_upkeep(spark, sf_dir):
    """K6 + K5 + A5: entry counts of a ledger before and after expiry, and after clearing; how many each removed."""
    ledger, _, _ = _new_ledger(spark, sf_dir)
    stats = lambda step: ledger.stats().select(F.lit(step).alias("step"), "total_entries", "ttl_days")
    out = [materialize(stats("written"))]
    removed = [0, ledger.clear_expired(LEDGER_NOW)]
    out.append(materialize(stats("expired")))
    removed.append(ledger.clear())
    out.append(materialize(stats("cleared")))
    rows = [o.withColumn("removed", F.lit(r).cast("long")) for o, r in zip(out, removed)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _fuzzy_words(threshold, strategy):
    def run(spark, sf_dir):
        params = SearchParams(threshold=threshold, strategy=strategy)
        # written once, as the join reads them more than once
        words = materialize(rolls.document_words(spark, sf_dir))
        found = fuzzy_join(words, rolls.benchmark_names(spark, sf_dir), params)
        return found.select("name", "query")

    run.__doc__ = f"J1 over all words of the documents and benchmark texts, threshold {threshold}, {strategy} strategy."
    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: text-mode search of the sf0.001 roll pages at threshold 82."""
    ship_package(spark)
    return _fuzzy(82, "auto")(spark, "/root/testdata/sf0.001")


def _shipped(fn):
    """Ship the package to the executors before a query builds its plan."""

    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = _queries_raw() | (llm_queries.queries() if llm_queries else {})
    return {k: _shipped(v) for k, v in found.items()}


def _queries_raw() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "normalize_names": q_normalize_names,
        "block_split": q_block_split,
        "extract_records": q_extract_records,
        "extract_records_strict": q_extract_records_strict,
        "page_cap": q_page_cap,
        "fuzzy_search": _fuzzy(82, "auto"),
        "fuzzy_search_t70": _fuzzy(70, "auto"),
        "fuzzy_search_t100": _fuzzy(100, "auto"),
        "fuzzy_search_t50": _fuzzy(50, "auto"),
        "fuzzy_search_shuffled": _fuzzy(82, "shuffle"),
        "fuzzy_search_shuffled_t70": _fuzzy(70, "shuffle"),
        "fuzzy_search_detail": q_fuzzy_search_detail,
        "word_filter": q_word_filter,
        "rebuild_text": q_rebuild_text,
        "rebuild_text_flat": q_rebuild_text_flat,
        "best_word": q_best_word,
        "record_boxes": q_record_boxes,
        "record_boxes_flat": q_record_boxes_flat,
        "csv_view": q_csv_view,
        "report_view": q_report_view,
        "path_filter": q_path_filter,
        "validate_files": q_validate_files,
        "content_hash": q_content_hash,
        "ocr_pages": q_ocr_pages,
        "run_stats": q_run_stats,
        "error_summary": q_error_summary,
        "query_list": q_query_list,
        "names_hash": q_names_hash,
        "ledger_hits": q_ledger_hits,
        "ledger_misses": q_ledger_misses,
        "ledger_expire": q_ledger_expire,
        "ledger_keys": q_ledger_keys,
        "extract_records_all": q_extract_records_all,
        "report_view_text": q_report_view_text,
        "truncated_files": q_truncated_files,
        "truncated_lists": q_truncated_lists,
        "ledger_param_change": q_ledger_param_change,
        "ledger_round_trip": q_ledger_round_trip,
        "ledger_upkeep": q_ledger_upkeep,
        "json_round_trip": q_json_round_trip,
        "csv_round_trip": q_csv_round_trip,
        "pages_scan": q_pages_scan,
        "run_union": q_run_union,
        "fuzzy_words": _fuzzy_words(82, "auto"),
        "fuzzy_words_shuffled": _fuzzy_words(82, "shuffle"),
        "fuzzy_words_t66": _fuzzy_words(66, "shuffle"),
        "file_scan": q_file_scan,
        "file_hashes": q_file_hashes,
        "search_run": q_search_run,
        "search_run_stats": q_search_run_stats,
        "ocr_words": q_ocr_words,
        "result_order": q_result_order,
        "json_array_round_trip": q_json_array_round_trip,
        "empty_results": q_empty_results,
    }


# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------
# Spelled out here, not taken from the engine: a wrong constant there must not stay unseen.
NORMALIZE_DELETE = "\u0983\u0964\u09cd "
WS_CODES = (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202,
    8232, 8233, 8239, 8287, 12288,
)
WS_CLASS = "[" + "".join(f"\\x{{{c:x}}}" for c in WS_CODES) + "]"
WS = "||".join(f"chr({c})" for c in WS_CODES)
NPAT = f"(?m)নাম{WS_CLASS}*[:：]{WS_CLASS}*(.{{1,200}}?)(?:\\n|$)"
NPAT_STRICT = f"(?m)^নাম{WS_CLASS}*[:：]{WS_CLASS}*(.{{1,200}}?)(?:\\n|$)"
ANY_FIELD = f"(?m)(^নাম|পিতার নাম|স্বামীর নাম){WS_CLASS}*[:：]{WS_CLASS}*(.{{1,200}}?)(?:\\n|$)"
GPAT = f"(?m)(পিতার নাম|স্বামীর নাম){WS_CLASS}*[:：]{WS_CLASS}*(.{{1,200}}?)(?:\\n|$)"


def _strip(x: str) -> str:
    return f"trim({x}, {WS})"


def _norm(x: str) -> str:
    return f"coalesce(trim(translate({x}, '{NORMALIZE_DELETE}', ''), {WS}), '')"


def _lcs(a: str, b: str) -> str:
    return (
        f"list_last(list_reduce(string_split({a}, ''), lambda row, ch: "
        f"list_reduce(list_transform(range(2, length({b}) + 2), "
        f"lambda j: [greatest(row[j], row[j-1] + (CASE WHEN {b}[j-1] = ch THEN 1 ELSE 0 END))]), "
        f"lambda acc, x: list_append(acc, greatest(acc[-1], x[1])), [0::bigint]), "
        f"list_transform(range(0, length({b}) + 1), lambda k: 0::bigint)))"
    )


def _blocks_sql(src: str = "roll_pages") -> str:
    return f"""
blocks AS (
  SELECT path, file, page, CAST(s.i - 1 AS INTEGER) AS block_pos, s.blk AS block
  FROM {src}, LATERAL (SELECT unnest(string_split(text, chr(10) || chr(10))) AS blk,
                                   generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i) s)
"""


BLOCKS_SQL = _blocks_sql()


def _records_sql(npat: str = NPAT) -> str:
    return f"""
recs0 AS (
  SELECT path, file, page, block_pos,
         regexp_extract(block, '{npat}', 1) AS n0,
         regexp_extract(block, '{GPAT}', 2) AS f0,
         regexp_extract(block, '{GPAT}', 1) AS relation
  FROM blocks),
recs AS (
  SELECT path, file, page, block_pos, {_strip('n0')} AS name, {_strip('f0')} AS father, relation
  FROM recs0 WHERE n0 <> '' AND f0 <> '')
"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def _tokens(x: str) -> str:
    """str.split() of an already stripped string (no tokens for '')."""
    return f"CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({x}, '{WS_CLASS}+') END"


def _pairs_sql(threshold: int) -> str:
    """Token-set score of distinct normalised pairs (brute force over all pairs)."""
    return f"""
rn AS (SELECT DISTINCT {_norm('name')} AS a FROM recs WHERE name <> ''),
qn AS (SELECT DISTINCT {_norm('query')} AS b FROM roll_queries WHERE query <> ''),
tp AS (
  SELECT a, b, list_distinct({_tokens('a')}) AS ta, list_distinct({_tokens('b')}) AS tb FROM rn, qn),
tq AS (
  SELECT a, b, ta, tb,
         array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(tb, x))), ' ') AS x,
         array_to_string(list_sort(list_filter(tb, lambda y: NOT list_contains(ta, y))), ' ') AS y,
         length(array_to_string(list_sort(list_intersect(ta, tb)), ' ')) AS sect
  FROM tp),
tr AS (
  SELECT *, CASE WHEN sect > 0 THEN 1 ELSE 0 END AS glue,
         CASE WHEN x = '' OR y = '' THEN 0 ELSE {_lcs('x', 'y')} END AS lcs
  FROM tq),
ts AS (
  SELECT a, b,
    CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0
         WHEN sect > 0 AND (x = '' OR y = '') THEN 100.0
         ELSE greatest(
           100.0 - 100.0 * CAST(length(x) + length(y) - 2 * lcs AS DOUBLE)
                 / CAST(2 * (sect + glue) + length(x) + length(y) AS DOUBLE),
           CASE WHEN sect = 0 THEN 0.0 ELSE 100.0 - 100.0 * CAST(glue + length(x) AS DOUBLE)
                                              / CAST(2 * sect + glue + length(x) AS DOUBLE) END,
           CASE WHEN sect = 0 THEN 0.0 ELSE 100.0 - 100.0 * CAST(glue + length(y) AS DOUBLE)
                                              / CAST(2 * sect + glue + length(y) AS DOUBLE) END)
    END AS score
  FROM tr),
pairs AS (SELECT a, b FROM ts WHERE score >= {int(threshold)})
"""


def _fuzzy_sql(threshold: int, detail: bool = False) -> str:
    pairs = _pairs_sql(threshold)
    cols = "r.path, r.page, r.block_pos, r.name, r.father, q.query" if detail else "r.file, r.page, r.name, r.father"
    return _with(rolls.ROLL_PAGES_SQL, rolls.ROLL_QUERIES_SQL, BLOCKS_SQL, _records_sql(), pairs) + f"""
SELECT {cols}
FROM recs r JOIN pairs p ON {_norm('r.name')} = p.a
JOIN roll_queries q ON {_norm('q.query')} = p.b
WHERE r.name <> '' AND q.query <> ''
"""


KEPT_SQL = f"""
kept AS (
  SELECT path, page, word_pos, block_num, par_num, line_num, {_strip('text')} AS text, confidence,
         bbox_left, bbox_top, bbox_width, bbox_height
  FROM roll_words WHERE {_strip('text')} <> '' AND confidence >= 60)
"""

BOX_PAGES_LINES_SQL = """
seq AS (
  SELECT path, page, block_num, par_num, line_num, word_pos, text,
         lag(block_num) OVER w AS pb, lag(par_num) OVER w AS pp, lag(line_num) OVER w AS pl
  FROM kept WINDOW w AS (PARTITION BY path, page ORDER BY block_num, par_num, line_num, word_pos)),
box_pages AS (
  SELECT path, regexp_extract(path, '[^/]*$') AS file, page,
         string_agg(CASE WHEN pb IS NULL THEN '' WHEN pb <> block_num THEN chr(10) || chr(10)
                         WHEN pp <> par_num OR pl <> line_num THEN chr(10) ELSE ' ' END || text, ''
                    ORDER BY block_num, par_num, line_num, word_pos) AS text
  FROM seq GROUP BY path, page)
"""

BOX_PAGES_FLAT_SQL = """
box_pages AS (
  SELECT path, regexp_extract(path, '[^/]*$') AS file, page, string_agg(text, ' ' ORDER BY word_pos) AS text
  FROM kept GROUP BY path, page)
"""


def _split_tokens(x: str) -> str:
    return f"regexp_split_to_array({_strip(x)}, '{WS_CLASS}+')"


def _box_sql(layout: str, select: str, threshold: int = 82) -> str:
    pages_sql = BOX_PAGES_LINES_SQL if layout == "lines" else BOX_PAGES_FLAT_SQL
    box = f"""
matches AS (
  SELECT r.path, r.file, r.page, r.block_pos, r.name, r.father
  FROM recs r JOIN pairs p ON {_norm('r.name')} = p.a
  JOIN roll_queries q ON {_norm('q.query')} = p.b
  WHERE r.name <> '' AND q.query <> ''),
mrec AS (SELECT DISTINCT path, page, block_pos, name, father FROM matches),
toks AS (
  SELECT path, page, block_pos, 'name' AS field, CAST(s.i - 1 AS INTEGER) AS tok_pos, s.tok AS token
  FROM mrec, LATERAL (SELECT unnest({_split_tokens('name')}) AS tok,
                             generate_subscripts({_split_tokens('name')}, 1) AS i) s
  WHERE {_strip('name')} <> ''
  UNION ALL
  SELECT path, page, block_pos, 'father' AS field, CAST(s.i - 1 AS INTEGER) AS tok_pos, s.tok AS token
  FROM mrec, LATERAL (SELECT unnest({_split_tokens('father')}) AS tok,
                             generate_subscripts({_split_tokens('father')}, 1) AS i) s
  WHERE {_strip('father')} <> ''),
tn AS (SELECT *, {_norm('token')} AS t, length({_norm('token')}) AS tl FROM toks),
wn AS (SELECT path, page, word_pos, text AS w_text, confidence AS w_conf,
              bbox_left, bbox_top, bbox_width, bbox_height,
              {_norm('text')} AS w, length({_norm('text')}) AS wl FROM kept),
cand AS (
  SELECT tn.path, tn.page, tn.block_pos, tn.field, tn.tok_pos, tn.t, tn.tl,
         wn.word_pos, wn.w_text, wn.w_conf, wn.bbox_left, wn.bbox_top, wn.bbox_width, wn.bbox_height, wn.w, wn.wl
  FROM tn JOIN wn ON tn.path = wn.path AND tn.page = wn.page
  WHERE 200 * least(tl, wl) >= 70 * (tl + wl)),
sc AS (SELECT *, CASE WHEN tl = 0 OR wl = 0 THEN 0 ELSE {_lcs('t', 'w')} END AS lcs FROM cand),
ok AS (
  SELECT *, CASE WHEN tl + wl = 0 THEN 100.0 ELSE 200.0 * lcs / (tl + wl) END AS w_score
  FROM sc WHERE 200 * lcs >= 70 * (tl + wl)),
best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY path, page, block_pos, field, tok_pos
                                 ORDER BY w_score DESC, word_pos) AS rn FROM ok)
  WHERE rn = 1 AND w_score > 0),
dw AS (SELECT DISTINCT path, page, block_pos, field, w_text, w_conf, bbox_left, bbox_top, bbox_width, bbox_height FROM best),
pf AS (
  SELECT path, page, block_pos, field, min(bbox_left) AS l, min(bbox_top) AS t,
         max(bbox_left + bbox_width) AS r, max(bbox_top + bbox_height) AS b, sum(w_conf) AS cs, count(*) AS n
  FROM dw GROUP BY path, page, block_pos, field),
boxes AS (
  SELECT path, page, block_pos,
         max(CASE WHEN field = 'name' THEN l END) AS bbox_left,
         max(CASE WHEN field = 'name' THEN t END) AS bbox_top,
         max(CASE WHEN field = 'name' THEN r - l END) AS bbox_width,
         max(CASE WHEN field = 'name' THEN b - t END) AS bbox_height,
         sum(cs) / sum(n) AS confidence
  FROM pf GROUP BY path, page, block_pos),
results AS (
  SELECT m.file, m.page, m.name, m.father,
         CAST(x.bbox_left AS INTEGER) AS bbox_left, CAST(x.bbox_top AS INTEGER) AS bbox_top,
         CAST(x.bbox_width AS INTEGER) AS bbox_width, CAST(x.bbox_height AS INTEGER) AS bbox_height,
         x.confidence
  FROM matches m LEFT JOIN boxes x ON m.path = x.path AND m.page = x.page AND m.block_pos = x.block_pos)
"""
    return _with(
        rolls.ROLL_PAGES_SQL, rolls.ROLL_WORDS_SQL, rolls.ROLL_QUERIES_SQL, KEPT_SQL, pages_sql,
        _blocks_sql("box_pages"), _records_sql(), _pairs_sql(threshold), box,
    ) + select


PDF_WHERE = "ends_with(lower(path), '.pdf')"
FILE_OF = "regexp_extract(path, '[^/]*$')"
RESOLVED = (
    "'/' || array_to_string(list_reduce(list_filter(string_split(path, '/'), lambda s: s <> '' AND s <> '.'), "
    "lambda acc, seg: CASE WHEN seg = '..' THEN acc[1:len(acc) - 1] ELSE list_append(acc, seg) END, "
    "[]::VARCHAR[]), '/')"
)
NO_PDF = "CASE WHEN NOT starts_with(hex(content), '255044462D') THEN 'File is not a valid PDF: ' || path END"
FILE_ERROR = (
    "CASE WHEN octet_length(content) / 1048576.0 > 0.02 "
    "THEN printf('PDF file too large: %.1fMB (max: 0.02MB)', octet_length(content) / 1048576.0) "
    "WHEN NOT starts_with(hex(content), '255044462D') THEN 'File is not a valid PDF: ' || path END"
)
OCR_SQL = f"""
chk AS (
  SELECT f.doc_id, f.path, {FILE_OF.replace('path', 'f.path')} AS file, f.content, d.text,
         {NO_PDF.replace('path', 'f.path')} AS error
  FROM doc_files f JOIN documents d ON f.doc_id = d.doc_id WHERE {PDF_WHERE.replace('path', 'f.path')}),
lns AS (
  SELECT path, file, l.i AS i, l.ln AS ln
  FROM chk, LATERAL (SELECT unnest(string_split(text, chr(10))) AS ln,
                            generate_subscripts(string_split(text, chr(10)), 1) AS i) l
  WHERE error IS NULL),
pg AS (
  SELECT path, file, CAST((i - 1) // 4 + 1 AS INTEGER) AS page, string_agg(ln, chr(10) ORDER BY i) AS text
  FROM lns GROUP BY path, file, (i - 1) // 4 + 1),
ocr AS (
  SELECT path, file, page, CASE WHEN contains(text, '@') THEN NULL ELSE text END AS text,
         CASE WHEN contains(text, '@') THEN 'page' END AS level,
         CASE WHEN contains(text, '@') THEN 'Error processing page ' || CAST(page AS VARCHAR)
              || ': page holds an e-mail address' END AS message
  FROM pg
  UNION ALL
  SELECT path, file, CAST(NULL AS INTEGER), NULL, 'file', file || ': ' || error FROM chk WHERE error IS NOT NULL),
doc_pages AS (SELECT path, file, page, text FROM ocr WHERE level IS NULL),
all_pages AS (SELECT * FROM doc_pages UNION ALL SELECT path, file, page, text FROM roll_pages),
errs AS (SELECT path, file, page, level, message FROM ocr WHERE level IS NOT NULL)
"""
NAME_FILES_SQL = """
name_files AS (
  SELECT '/data/names/names_' || lpad(CAST(p_partkey // 1000 AS VARCHAR), 5, '0') || '.txt' AS path,
         string_agg(CASE WHEN p_partkey % 10 = 9 THEN '  ' || p_name || chr(10) ELSE p_name END, chr(10)
                    ORDER BY p_partkey) AS value
  FROM part GROUP BY p_partkey // 1000)
"""
NAMES_SQL = NAME_FILES_SQL + f""",
kept_names AS (
  SELECT path, list_filter(list_transform(regexp_split_to_array(regexp_replace(value, '^\\x{{feff}}', ''), '\\r\\n|\\r|\\n'),
                                          lambda s: {_strip('s')}), lambda s: s <> '') AS names
  FROM name_files),
names AS (
  SELECT path, CAST(n.i AS INTEGER) AS query_pos, n.q AS query
  FROM kept_names, LATERAL (SELECT unnest(names) AS q, generate_subscripts(names, 1) AS i) n
  )
"""
# names hash: the names sorted by code point, joined by '|'
NH_SQL = "(SELECT substr(sha256(string_agg(query, '|' ORDER BY query)), 1, 16) FROM roll_queries)"


def _settings_sql(threshold: int = 82, pages: str = "none") -> str:
    """Digest of the result-changing parameters, spelled out."""
    return (
        f"substr(sha256('threshold={threshold}|box_level=false|min_confidence=60|max_pdf_size_mb=50|max_pdf_pages={pages}"
        "|word_match_threshold=70|layout=flat|strict_labels=false|all_records=false|name_label=নাম|guardian_labels=পিতার নাম,স্বামীর নাম'), 1, 16)"
    )
LEDGER_SQL = f"""
le0 AS (
  SELECT doc_id, sha256(content) AS file_hash, {NH_SQL} AS names_hash,
         CASE WHEN doc_id % 3 = 0 THEN 90 ELSE 82 END AS threshold, CASE WHEN doc_id % 13 = 0 THEN {_settings_sql(pages='5')} ELSE {_settings_sql()} END AS settings,
         CASE WHEN doc_id % 11 = 0 THEN '0.9' ELSE '1.0' END AS version,
         TIMESTAMP '{rolls.LEDGER_NOW}' - to_days(CAST(doc_id % 45 AS INTEGER)) AS ts, path AS pdf_path,
         CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS n_results, 1 AS res_page
  FROM doc_files),
ledger AS (
  SELECT * FROM le0
  UNION ALL
  SELECT doc_id, file_hash, names_hash, threshold, settings, version,
         ts - INTERVAL 1 DAY, pdf_path, n_results, 2 FROM le0 WHERE doc_id % 7 = 0),
valid AS (
  SELECT * FROM ledger
  WHERE names_hash = {NH_SQL} AND threshold = 82 AND settings = {_settings_sql()}
    AND version = '1.0' AND ts >= TIMESTAMP '{rolls.LEDGER_NOW}' - INTERVAL 30 DAY),
newest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY file_hash, names_hash, threshold, settings, version
                                 ORDER BY ts DESC, pdf_path DESC) AS rn FROM valid) WHERE rn = 1),
pdfs AS (SELECT path, sha256(content) AS file_hash FROM doc_files WHERE {PDF_WHERE})
"""


# One token on either side: the score is 200 * common / (sum of lengths).  Pairs whose lengths, or whose edit distance
# (never above that of insertions and deletions alone), cannot reach 82 are left out first.
WORDS_SQL = _with(rolls.WORD_NAMES_SQL) + f"""
, near AS (
  SELECT name, query FROM word_names, word_queries
  WHERE 200 * least(length(name), length(query)) >= 82 * (length(name) + length(query))
    AND levenshtein(name, query) <= 18 * (length(name) + length(query)) // 100
      * CASE WHEN strlen(name) + strlen(query) = length(name) + length(query) THEN 1 ELSE 4 END)  -- it counts bytes
SELECT name, query FROM near WHERE 200 * {_lcs('name', 'query')} >= 82 * (length(name) + length(query))
"""

def _run_sql() -> str:
    return _with(rolls.ROLL_PAGES_SQL, rolls.ROLL_QUERIES_SQL, BLOCKS_SQL, _records_sql(), _pairs_sql(82), RUN_SQL)


RUN_SQL = f"""
hits AS (
  SELECT r.path, r.file, r.page, r.block_pos, r.name, r.father, q.query
  FROM recs r JOIN pairs p ON {_norm('r.name')} = p.a
  JOIN roll_queries q ON {_norm('q.query')} = p.b WHERE r.name <> '' AND q.query <> '')
"""


def oracle_sql() -> dict[str, str]:
    return _oracle_raw() | (llm_queries.oracle_sql() if llm_queries else {})


def _oracle_raw() -> dict[str, str]:
    pages = rolls.ROLL_PAGES_SQL
    files = rolls.DOC_FILES_SQL
    ocr = _with(files, rolls.ROLL_PAGES_SQL, OCR_SQL)
    words = _with(pages, rolls.ROLL_WORDS_SQL, KEPT_SQL)
    return {
        "path_filter": _with(files, f"np AS (SELECT path, {RESOLVED} AS resolved FROM doc_files)")
        + f"SELECT path, {FILE_OF} AS file, resolved FROM np WHERE {PDF_WHERE} "
        "AND (resolved = '/data/src1' OR starts_with(resolved, '/data/src1/'))",
        "validate_files": _with(files)
        + f"SELECT path, {FILE_OF} AS file, octet_length(content) AS length, "
        f"octet_length(content) / 1048576.0 AS size_mb, {FILE_ERROR} AS error "
        f"FROM doc_files WHERE {PDF_WHERE}",
        "ledger_keys": _with(files, rolls.ROLL_QUERIES_SQL)
        + f"SELECT path, sha256(content) || '_' || {NH_SQL} || '_82_' || {_settings_sql()} AS ledger_key "
        f"FROM doc_files WHERE {PDF_WHERE}",
        "extract_records_all": _with(pages, BLOCKS_SQL)
        + f"""
, fields AS (
  SELECT path, file, page, block_pos, f.i, f.label, f.value
  FROM blocks, LATERAL (
    SELECT unnest(ls) AS label, unnest(vs) AS value, generate_subscripts(ls, 1) AS i
    FROM (SELECT regexp_extract_all(block, '{ANY_FIELD}', 1) AS ls, regexp_extract_all(block, '{ANY_FIELD}', 2) AS vs)) f),
around AS (
  SELECT *, lead(label) OVER w AS next_label, lead(value) OVER w AS next_value,
         first_value(label) OVER w AS first_label, first_value(value) OVER w AS first_value,
         count(*) FILTER (WHERE label = 'নাম') OVER (PARTITION BY path, page, block_pos ORDER BY i
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth
  FROM fields WINDOW w AS (PARTITION BY path, page, block_pos ORDER BY i)),
paired AS (
  SELECT path, file, page, block_pos, CAST(nth - 1 AS INTEGER) AS record_pos, value,
         CASE WHEN next_label <> 'নাম' THEN next_label WHEN nth = 1 AND first_label <> 'নাম' THEN first_label END AS relation,
         CASE WHEN next_label <> 'নাম' THEN next_value WHEN nth = 1 AND first_label <> 'নাম' THEN first_value END AS g
  FROM around WHERE label = 'নাম')
SELECT path, file, page, block_pos, record_pos, {_strip('value')} AS name, {_strip('g')} AS father, relation
FROM paired WHERE relation IS NOT NULL""",
        "truncated_files": _with(pages)
        + "SELECT path, CAST(NULL AS INTEGER) AS page, 'warning' AS level, "
        "'searched the first 3 of ' || CAST(max(page) AS VARCHAR) || ' pages' AS message FROM roll_pages GROUP BY path HAVING max(page) > 3",
        "truncated_lists": _with(NAMES_SQL)
        + "SELECT path, CAST(NULL AS INTEGER) AS page, 'warning' AS level, "
        "'searched the first 300 of ' || CAST(count(*) AS VARCHAR) || ' names' AS message FROM names GROUP BY path HAVING count(*) > 300",
        "ledger_param_change": _with(files, rolls.ROLL_QUERIES_SQL, LEDGER_SQL)
        + f"""
, by_setting AS (
  SELECT *, row_number() OVER (PARTITION BY file_hash, settings ORDER BY ts DESC, pdf_path DESC) AS rn FROM ledger
  WHERE threshold = 82 AND version = '1.0' AND ts >= TIMESTAMP '{rolls.LEDGER_NOW}' - INTERVAL 30 DAY)
SELECT CASE WHEN settings = {_settings_sql()} THEN 'all pages' ELSE 'first 5' END AS setting,
  p.path, b.res_page AS page, 'name ' || CAST(b.doc_id AS VARCHAR) AS name
FROM by_setting b JOIN pdfs p ON p.file_hash = b.file_hash WHERE rn = 1 AND n_results > 0""",
        "ledger_round_trip": _with(files)
        + f"""
, p AS (SELECT path, doc_id, sha256(content) AS h FROM doc_files WHERE {PDF_WHERE}),
e AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path DESC) AS rn FROM p WHERE doc_id % 4 > 0)
SELECT p.path, 'name ' || CAST(e.doc_id AS VARCHAR) AS name, 'hit' AS kind
FROM p JOIN e ON p.h = e.h AND e.rn = 1 WHERE e.doc_id % 3 > 0
UNION ALL
SELECT p.path, NULL, 'todo' FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.h = p.h)""",
        "ledger_upkeep": _with(files)
        + f"""
, p AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 4 > 0) AS young FROM doc_files WHERE {PDF_WHERE})
SELECT 'written' AS step, n AS total_entries, 30 AS ttl_days, CAST(0 AS BIGINT) AS removed FROM p
UNION ALL SELECT 'expired', young, 30, n - young FROM p
UNION ALL SELECT 'cleared', CAST(0 AS BIGINT), 30, young FROM p""",
        "json_round_trip": _fuzzy_sql(82),
        "csv_round_trip": _box_sql(
            "lines",
            "SELECT file, CAST(page AS VARCHAR) AS page, ' ' || name || ' ' AS name, father, "
            + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in ("bbox_left", "bbox_top", "bbox_width", "bbox_height"))
            + ", CASE WHEN confidence IS NULL THEN '' ELSE printf('%.2f', confidence) END AS confidence FROM results",
        ),
        "pages_scan": _with(pages) + "SELECT path, file, page, text FROM roll_pages",
        "run_union": _with(rolls.ROLL_PAGES_SQL, rolls.ROLL_QUERIES_SQL, BLOCKS_SQL, _records_sql(), _pairs_sql(82), files, LEDGER_SQL)
        + f"""
SELECT r.file, r.page, r.name, r.father FROM recs r JOIN pairs p ON {_norm('r.name')} = p.a
JOIN roll_queries q ON {_norm('q.query')} = p.b WHERE r.name <> '' AND q.query <> ''
UNION ALL
SELECT {FILE_OF.replace('path', 'f.path')}, n.res_page, 'name ' || CAST(n.doc_id AS VARCHAR), 'guardian'
FROM pdfs f JOIN newest n ON f.file_hash = n.file_hash WHERE n.n_results > 0""",
        "file_scan": ocr + "SELECT split_part(path, '/', 3) || '_' || file AS file, page, text, level, "
        "CASE WHEN level = 'file' THEN split_part(path, '/', 3) || '_' || file || ': File is not a valid PDF: /' || split_part(path, '/', 3) || '_' || file "
        "ELSE message END AS message FROM ocr",
        "file_hashes": ocr + "SELECT split_part(path, '/', 3) || '_' || file AS file, sha256(content) AS file_hash FROM chk WHERE error IS NULL",
        "search_run": _run_sql() + "SELECT run, file, page, name, father FROM hits, (SELECT unnest([1, 2]) AS run)",
        "search_run_stats": _run_sql()
        + """, f AS (SELECT DISTINCT path, CAST(substr(file, 6, 5) AS INTEGER) AS k FROM roll_pages),
n AS (SELECT count(*) AS files, count(*) FILTER (WHERE k % 7 = 0) AS bad, count(*) FILTER (WHERE k % 5 = 0) AS unreadable FROM f)
SELECT run, n.files AS files_processed, n.bad AS files_failed,
  CASE WHEN run = 1 THEN (SELECT count(*) FROM roll_pages) ELSE 0 END AS pages_processed,
  (SELECT count(*) FROM hits) AS matches_found,
  n.bad + CASE WHEN run = 1 THEN n.unreadable ELSE 0 END AS error_count
FROM n, (SELECT unnest([1, 2]) AS run)""",
        "ocr_words": _with(pages, rolls.ROLL_WORDS_SQL)
        + """SELECT regexp_extract(path, '[^/]*$') AS file, page,
  ((CAST(block_num AS BIGINT) * 1000 + 1) * 1000 + line_num) * 10000 + word_pos % 100 + 1 AS word_pos, block_num, par_num,
  CAST(line_num AS INTEGER) AS line_num,
  replace(text, chr(9), '_') || CASE WHEN word_pos % 10 = 3 THEN '"' ELSE '' END AS text, confidence, bbox_left, bbox_top, bbox_width, bbox_height
FROM roll_words""",
        "result_order": _run_sql()
        + "SELECT path, page, block_pos, query, name, row_number() OVER (ORDER BY path, page, block_pos, query, name) AS result_pos FROM hits",
        "json_array_round_trip": _run_sql()
        + """, o AS (SELECT *, row_number() OVER (ORDER BY path, page, block_pos, query, name) AS n, count(*) OVER () AS total FROM hits)
SELECT path, page, block_pos, query, name, n = 1 AS opens, n = total AS closes FROM o""",
        "empty_results": "SELECT 'csv' AS kind, 'file,page,name,father' AS line UNION ALL SELECT 'json', '[]'",
        "fuzzy_words": WORDS_SQL,
        "fuzzy_words_shuffled": WORDS_SQL,
        "report_view_text": _with(rolls.ROLL_PAGES_SQL, rolls.ROLL_QUERIES_SQL, BLOCKS_SQL, _records_sql(), _pairs_sql(82))
        + f"""SELECT r.file AS "File", CAST(r.page AS VARCHAR) AS "Page", r.name AS "Name", r.father AS "Father / Guardian"
FROM recs r JOIN pairs p ON {_norm('r.name')} = p.a
JOIN roll_queries q ON {_norm('q.query')} = p.b
WHERE r.name <> '' AND q.query <> ''""",
        "content_hash": _with(files) + "SELECT path, sha256(content) AS file_hash FROM doc_files",
        "ocr_pages": ocr + "SELECT path, page, text, level, message FROM ocr",
        "run_stats": _with(
            files, rolls.ROLL_PAGES_SQL, OCR_SQL, rolls.ROLL_QUERIES_SQL, _blocks_sql("all_pages"), _records_sql(), _pairs_sql(82),
            """matches AS (
  SELECT r.file FROM recs r JOIN pairs p ON """ + _norm("r.name") + """ = p.a
  JOIN roll_queries q ON """ + _norm("q.query") + """ = p.b WHERE r.name <> '' AND q.query <> '')""",
        )
        + f"""SELECT
  (SELECT count(*) FROM chk WHERE error IS NULL) + (SELECT count(DISTINCT path) FROM roll_pages) AS files_processed,
  (SELECT count(*) FROM chk WHERE error IS NOT NULL) AS files_failed,
  (SELECT count(*) FROM all_pages) AS pages_processed,
  (SELECT count(*) FROM matches) AS matches_found,
  (SELECT count(*) FROM errs) AS error_count,
  (SELECT list(m ORDER BY path, page NULLS FIRST, m) FROM (
     SELECT path, page, CASE WHEN level = 'page' THEN file || ': ' || message ELSE message END AS m
     FROM errs ORDER BY path, page NULLS FIRST, m LIMIT 10)) AS errors""",
        "error_summary": _with(
            files, rolls.ROLL_PAGES_SQL, OCR_SQL,
            "msgs AS (SELECT path, page, CASE WHEN level = 'page' THEN file || ': ' || message ELSE message END AS message FROM errs)",
            "top AS (SELECT * FROM msgs ORDER BY path, page NULLS FIRST, message LIMIT 10)",
            "cnt AS (SELECT count(*) AS n FROM msgs)",
        )
        + """SELECT n AS error_count,
  (SELECT list(message ORDER BY path, page NULLS FIRST, message) FROM top) AS first_errors,
  CASE WHEN n > 10 THEN '... and ' || CAST(n - 10 AS VARCHAR) || ' more' END AS more FROM cnt""",
        "query_list": _with(NAMES_SQL) + "SELECT path, query_pos, query FROM names WHERE query_pos <= 300",
        "names_hash": _with(NAMES_SQL)
        + "SELECT path, substr(sha256(string_agg(query, '|' ORDER BY query)), 1, 16) AS names_hash FROM names GROUP BY path",
        "ledger_hits": _with(files, rolls.ROLL_QUERIES_SQL, LEDGER_SQL)
        + f"""SELECT f.path, {FILE_OF.replace('path', 'f.path')} AS file, n.res_page AS page,
  'name ' || CAST(n.doc_id AS VARCHAR) AS name, 'guardian' AS father
FROM pdfs f JOIN newest n ON f.file_hash = n.file_hash WHERE n.n_results > 0""",
        "ledger_misses": _with(files, rolls.ROLL_QUERIES_SQL, LEDGER_SQL)
        + "SELECT path FROM pdfs f WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.file_hash = f.file_hash)",
        "ledger_expire": _with(files, rolls.ROLL_QUERIES_SQL, LEDGER_SQL)
        + f"""SELECT count(*) AS total_entries,
  count(*) FILTER (WHERE ts < TIMESTAMP '{rolls.LEDGER_NOW}' - INTERVAL 30 DAY) AS expired,
  count(*) FILTER (WHERE ts >= TIMESTAMP '{rolls.LEDGER_NOW}' - INTERVAL 30 DAY) AS kept,
  count(*) FILTER (WHERE version = '1.0' AND ts >= TIMESTAMP '{rolls.LEDGER_NOW}' - INTERVAL 30 DAY) AS valid
FROM ledger""",
        "word_filter": words + "SELECT path, page, word_pos, text, confidence FROM kept",
        "rebuild_text": _with(pages, rolls.ROLL_WORDS_SQL, KEPT_SQL, BOX_PAGES_LINES_SQL)
        + "SELECT path, file, page, text FROM box_pages",
        "rebuild_text_flat": _with(pages, rolls.ROLL_WORDS_SQL, KEPT_SQL, BOX_PAGES_FLAT_SQL)
        + "SELECT path, file, page, text FROM box_pages",
        "best_word": _box_sql("lines", "SELECT path, page, block_pos, field, tok_pos, word_pos, w_text, w_conf, w_score FROM best"),
        "record_boxes": _box_sql("lines", "SELECT * FROM results"),
        "record_boxes_flat": _box_sql("flat", "SELECT * FROM results", threshold=10),
        "csv_view": _box_sql(
            "lines",
            "SELECT file, page, name, father, bbox_left, bbox_top, bbox_width, bbox_height, "
            "printf('%.2f', confidence) AS confidence FROM results",
        ),
        "report_view": _box_sql(
            "lines",
            "SELECT file AS \"File\", CAST(page AS VARCHAR) AS \"Page\", name AS \"Name\", "
            "father AS \"Father / Guardian\", CASE WHEN confidence IS NULL THEN 'N/A' "
            "ELSE printf('%.1f%%', confidence) END AS \"Confidence\" FROM results",
        ),
        "normalize_names": _with(pages, BLOCKS_SQL)
        + f"SELECT path, page, block_pos, {_norm('block')} AS norm FROM blocks",
        "block_split": _with(pages, BLOCKS_SQL)
        + "SELECT path, page, block_pos, CAST(length(block) AS INTEGER) AS block_chars, block FROM blocks",
        "extract_records": _with(pages, BLOCKS_SQL, _records_sql())
        + "SELECT path, file, page, block_pos, name, father, relation FROM recs",
        "extract_records_strict": _with(pages, BLOCKS_SQL, _records_sql(NPAT_STRICT))
        + "SELECT path, file, page, block_pos, name, father, relation FROM recs",
        "page_cap": _with(pages) + "SELECT path, page, CAST(length(text) AS INTEGER) AS chars FROM roll_pages WHERE page <= 3",
        "fuzzy_search": _fuzzy_sql(82),
        "fuzzy_search_t70": _fuzzy_sql(70),
        "fuzzy_search_t100": _fuzzy_sql(100),
        "fuzzy_search_t50": _fuzzy_sql(50),
        "fuzzy_search_shuffled": _fuzzy_sql(82),
        "fuzzy_search_shuffled_t70": _fuzzy_sql(70),
        "fuzzy_search_detail": _fuzzy_sql(82, detail=True),
    }
