"""Command line: the search run as a Spark job (``python -m rollscan search ...``).

Same options as the reference's ``search`` command where they still mean
something on a cluster; the OCR engine is named with ``--page-fn
module:function`` (see ``rollscan.sources.ocr.ocr_pages``), or a table of
already OCR'd pages is searched with ``--pages``, one of OCR words, in box mode,
with ``--words``.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from rollscan.params import DEFAULT_MIN_CONFIDENCE, DEFAULT_THRESHOLD, SearchParams


def _page_fn(spec: str):
    module, _, name = spec.partition(":")
    if not module or not name:
        raise ValueError(f"--page-fn must look like module:function, got {spec!r}")
    return getattr(importlib.import_module(module), name)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rollscan", description="Search scanned record rolls for names.")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="search a folder of PDFs (or a pages table) for names")
    s.add_argument("directory", nargs="?", help="folder with PDF files (searched recursively)")
    s.add_argument("-n", "--names-file", required=True, help="UTF-8 file, one name per line")
    s.add_argument("-t", "--threshold", type=int, default=DEFAULT_THRESHOLD, help="0..100")
    s.add_argument("-o", "--output", help="results path (.json or .csv, or use --format)")
    s.add_argument("-f", "--format", default="auto", help="json, csv or auto")
    s.add_argument("--page-fn", help="OCR page function as module:function")
    s.add_argument("--pages", help="search this Parquet table of page texts (path, page, text) instead")
    s.add_argument("--words", help="search this Parquet table of OCR words (path, page, word_pos, text, confidence, bbox, ...) in box mode")
    s.add_argument("--ledger", help="result ledger folder (skip files already searched)")
    s.add_argument("--clear-ledger", action="store_true", help="clear the ledger first")
    s.add_argument("--box-level", action="store_true", help="word boxes and confidence (box mode)")
    s.add_argument("--min-confidence", type=float, default=DEFAULT_MIN_CONFIDENCE, help="OCR word confidence floor 0..100")
    s.add_argument("--max-pages", type=int, help="search only the first pages of each file (reported)")
    s.add_argument("--max-names", type=int, help="search only the first names of the list (reported)")
    s.add_argument("--layout", default="flat", choices=["flat", "lines"], help="box-mode page layout")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = build_parser().parse_args(argv)
    params = SearchParams(
        threshold=args.threshold,
        box_level=args.box_level,
        min_confidence=args.min_confidence,
        layout=args.layout,
        max_pdf_pages=args.max_pages,
        max_search_names=args.max_names,
    )
    if args.pages or args.words:
        # a table has no files to hash, so no ledger entries; one of page texts has no words either
        table = "--pages" if args.pages else "--words"
        unfit = [o for o, v in (
            ("--words", args.pages and args.words), ("--box-level", args.pages and args.box_level),
            ("--ledger", args.ledger), ("--clear-ledger", args.clear_ledger), ("--page-fn", args.page_fn),
            ("--min-confidence", args.pages and args.min_confidence != DEFAULT_MIN_CONFIDENCE),
            ("--layout", args.pages and args.layout != "flat"), ("a PDF folder", args.directory),
        ) if v]
        if unfit:
            print(f"{table} cannot be used with {', '.join(unfit)}", file=sys.stderr)
            return 2
    if args.output:
        from rollscan.sinks.results import resolve_format

        resolve_format(args.output, args.format)  # fail before any job starts
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("rollscan").getOrCreate()
    from rollscan.operators.views import report_view
    from rollscan.sources.names import load_names

    names = load_names(spark, args.names_file, params)
    if args.pages or args.words:
        from rollscan.operators.filters import truncated_files
        from rollscan.plans.search import search_boxes, search_text
        from rollscan.sinks.results import write_results
        from rollscan.sources.pages import read_pages

        rows = read_pages(spark, args.pages) if args.pages else spark.read.parquet(args.words)
        if params.max_pdf_pages is not None:
            truncated_files(rows.select("path", "page"), params.max_pdf_pages).show(20, truncate=False)
        if args.pages:
            results = search_text(read_pages(spark, args.pages, params=params), names, params)
        else:
            results = search_boxes(rows, names, params.with_(box_level=True))
        if args.output:
            write_results(results, args.output, args.format)
        report_view(results.orderBy("file", "page")).show(20, truncate=False)
        return 0
    if not args.directory or not args.page_fn:
        print("a PDF folder needs --page-fn (or search a pages table with --pages)", file=sys.stderr)
        return 2
    from rollscan.plans.run import run_search

    out = run_search(
        spark, args.directory, names, _page_fn(args.page_fn), params,
        ledger_root=args.ledger, output_path=args.output, output_format=args.format,
        clear_ledger=args.clear_ledger,
    )
    # first rows in (file, page) order: a top-k, not a full sort of the results
    report_view(out.results.orderBy("file", "page")).show(20, truncate=False)
    out.stats.show(truncate=False)
    out.error_summary.show(truncate=False)
    if params.max_pdf_pages is not None:
        out.warnings.show(20, truncate=False)
    out.drop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
