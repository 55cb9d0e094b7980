"""rollscan: search scanned record rolls with Spark.

Labelled records (name, guardian) are extracted from page texts or OCR word
tables, matched exactly against a list of searched names with a normalised
similarity score, located on the page, and written with run statistics.

Main entry points (all take and return DataFrames):

* ``run_search``          the whole run over a folder of PDFs (scan, ledger, OCR plug, search, outputs)
* ``search_text``         text-mode search of a pages table
* ``search_boxes``        box-mode search of an OCR words table
* ``fuzzy_join``          the exact fuzzy join of any records against any name list
* ``extract_records``     labelled record extraction from page texts
* ``ocr_pages``           per-file page function (where an OCR engine plugs in)
* ``load_names`` / ``names_from_list``   name lists
* ``write_results``       JSON / CSV output with format dispatch
* ``Ledger``              result ledger (skip files already searched)
* ``run_stats`` / ``error_summary``      run statistics
"""

from rollscan.functions.similarity import token_set_ratio  # noqa: F401
from rollscan.functions.text import normalize_bn  # noqa: F401
from rollscan.operators.boxes import locate_records, page_texts  # noqa: F401
from rollscan.operators.extract import extract_records, split_blocks  # noqa: F401
from rollscan.operators.fuzzy_join import fuzzy_join  # noqa: F401
from rollscan.operators.stats import error_summary, run_stats  # noqa: F401
from rollscan.operators.views import csv_view, report_view, result_view  # noqa: F401
from rollscan.params import SearchParams  # noqa: F401
from rollscan.plans.run import run_search  # noqa: F401
from rollscan.plans.search import search_boxes, search_text  # noqa: F401
from rollscan.sinks.ledger import Ledger, names_hash  # noqa: F401
from rollscan.sinks.results import write_results  # noqa: F401
from rollscan.sources.files import scan_pdf_files, validate_files  # noqa: F401
from rollscan.sources.names import load_names, names_from_list  # noqa: F401
from rollscan.sources.ocr import PageError, ocr_pages  # noqa: F401
from rollscan.sources.pages import read_pages  # noqa: F401
from rollscan.sources.words import read_ocr_tsv  # noqa: F401
from rollscan.streaming.search_stream import start_search_stream, stream_search  # noqa: F401
