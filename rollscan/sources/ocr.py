"""T1 + E1: per-file table function that turns PDF bytes into page rows.

The OCR engine itself is a native per-page library and is not part of the
engine: the caller plugs it in as ``page_fn(path, content) -> iterable`` of
page results, each either a text (text mode) or a list of word dicts (box
mode).  ``ocr_pages`` runs it inside ``mapInArrow`` over the validated
``binaryFile`` rows, one file at a time, and isolates failures:

* a failed page is yielded as an exception instance (e.g. ``PageError``)
  and is skipped and reported as a ``page`` error, as is a page whose
  ``next()`` raises a non-``RuntimeError`` or a ``RuntimeError`` mentioning a
  timeout (a generator that raises cannot continue, so yielding the error is
  the way to go on with later pages);
* a ``RuntimeError`` from the file (e.g. rasteriser or OCR engine missing)
  fails the file: its earlier pages are dropped and a ``file`` error is
  reported;
* an invalid file (F2/F3) is a ``file`` error without calling ``page_fn``;
* of the pages after ``max_pdf_pages`` (F5/L2; no cap by default) one is
  requested, and if there is one, the file gets a ``warning`` row.

Output rows: ``path, file, page, text, words, level, message``; pages have
``level`` null, errors have ``level`` in ('page', 'file'), truncated files
have a row with ``level`` 'warning'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollscan.params import SearchParams
from rollscan.schemas import BBOX
from rollscan.session import ship_package
from rollscan.sources.files import fits, validate_files

WORD = T.StructType(
    [
        T.StructField("word_pos", T.LongType()),
        T.StructField("block_num", T.IntegerType()),
        T.StructField("par_num", T.IntegerType()),
        T.StructField("line_num", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("bbox", BBOX),
    ]
)

OCR_OUT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("words", T.ArrayType(WORD)),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)


class PageError(Exception):
    """Raised by a page function for one page; the page is skipped."""


PageFn = Callable[[str, bytes], Iterable]


# Rows of a batch that the page function's task hands on, and characters of its pages, at least, but for the last.
BATCH_ROWS = 4096
BATCH_CHARS = 4 * 1024 * 1024

# Messages of failed pages (same text as the reference).
MSG_TIMEOUT = "OCR timeout on page {page}"
MSG_PAGE = "Error processing page {page}: {error}"
MSG_FILE = "Unexpected error processing {file}: {error}"


def _run_file(path: str, file: str, content: bytes, page_fn: PageFn, max_pages: int | None) -> list[dict]:
    rows: list[dict] = []
    errors: list[dict] = []
    try:
        pages = iter(page_fn(path, content))
        page_no = 0
        while True:
            if page_no == max_pages:
                try:
                    more = next(pages, None) is not None
                except Exception:  # noqa: BLE001 - a page beyond the cap that fails is one all the same
                    more = True
                if more:
                    errors.append(_err(path, file, None, "warning", f"searched the first {page_no} pages only"))
                break
            page_no += 1
            try:
                result = next(pages)
            except StopIteration:
                break
            except RuntimeError as e:
                if "timeout" in str(e).lower():
                    errors.append(_err(path, file, page_no, "page", MSG_TIMEOUT.format(page=page_no)))
                    continue
                raise
            except Exception as e:  # noqa: BLE001 - page-level isolation
                errors.append(_err(path, file, page_no, "page", MSG_PAGE.format(page=page_no, error=e)))
                continue
            if isinstance(result, Exception):
                errors.append(_err(path, file, page_no, "page", MSG_PAGE.format(page=page_no, error=result)))
                continue
            if isinstance(result, str):
                rows.append(dict(path=path, file=file, page=page_no, text=result, words=None, level=None, message=None))
            else:
                words = [dict(w) for w in result]
                rows.append(dict(path=path, file=file, page=page_no, text=None, words=words, level=None, message=None))
    except RuntimeError as e:
        return errors + [_err(path, file, None, "file", f"{file}: {e}")]
    except Exception as e:  # noqa: BLE001 - file-level isolation, partial rows kept
        return rows + errors + [_err(path, file, None, "file", MSG_FILE.format(file=file, error=e))]
    return rows + errors


def _err(path, file, page, level, message) -> dict:
    return dict(path=path, file=file, page=page, text=None, words=None, level=level, message=message)


def row_batches(files: Iterable[list[dict]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of one file after the other: small files share a batch, up to ``BATCH_ROWS`` rows or
    ``BATCH_CHARS`` characters; one that exceeds them is a batch of its own or the last of one."""
    arrow = to_arrow_schema(schema)
    held: list[dict] = []
    chars = 0
    for rows in files:
        held += rows
        # a word takes about as much as a hundred characters of text
        chars += sum(len(r["text"] or "") + 100 * len(r["words"] or ()) for r in rows)
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def ocr_pages(files: DataFrame, page_fn: PageFn, params: SearchParams | None = None) -> DataFrame:
    """``binaryFile`` rows → page rows and error rows (see module doc).

    Files beyond the size limit become error rows from their length alone; the
    limit is a filter that the scan takes, so their bytes are never read.  One
    task handles the files of its input split one by one and hands on the
    rows of small files together, up to 4,096 rows or 4 M characters
    (``row_batches``).  The scan packs files into splits
    of at most ``spark.sql.files.maxPartitionBytes`` (plus one file), which also
    bounds the Arrow batch that carries their bytes to Python; lower it to
    spread files over more tasks (and less memory per task) rather than
    shuffling the file bytes.  Every step before this one (validation, ledger
    anti-join against a broadcast side) keeps that partitioning.
    """
    params = params or SearchParams()
    ship_package(files.sparkSession)
    checked = validate_files(files.where(fits(params)), params).select(
        "path", "file", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error"
    )
    max_pages = None if params.max_pdf_pages is None else int(params.max_pdf_pages)
    too_large = validate_files(files.where(~fits(params)).withColumn("content", F.lit(None).cast("binary")), params)
    too_large = too_large.select(
        "path", "file", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast(T.ArrayType(WORD)).alias("words"), F.lit("file").alias("level"),
        F.concat("file", F.lit(": "), "error").alias("message"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files_of_batches() -> Iterator[list[dict]]:
            for batch in batches:
                columns = [batch.column(c) for c in ("path", "file", "content", "error")]
                for path, file, content, error in zip(*columns):
                    if error.is_valid:
                        yield [_err(path.as_py(), file.as_py(), None, "file", f"{file}: {error}")]
                    else:
                        yield _run_file(path.as_py(), file.as_py(), content.as_py(), page_fn, max_pages)

        yield from row_batches(files_of_batches(), OCR_OUT)

    return checked.mapInArrow(run, OCR_OUT).unionByName(too_large)


def page_rows(ocr_out: DataFrame) -> DataFrame:
    """Text pages of ``ocr_pages`` output: ``path, file, page, text``."""
    return ocr_out.where(F.col("level").isNull() & F.col("text").isNotNull()).select("path", "file", "page", "text")


def word_rows(ocr_out: DataFrame) -> DataFrame:
    """Word rows of ``ocr_pages`` output in the ``words`` schema."""
    pages = ocr_out.where(F.col("level").isNull() & F.col("words").isNotNull())
    return pages.select("path", "page", F.explode("words").alias("w")).select("path", "page", "w.*")


def error_rows(ocr_out: DataFrame) -> DataFrame:
    """``errors(path, page, level, message)``."""
    return ocr_out.where(F.col("level").isin("page", "file")).select("path", "page", "level", "message")


def warning_rows(ocr_out: DataFrame) -> DataFrame:
    """F5's report: files whose pages were cut off, in the errors schema."""
    return ocr_out.where(F.col("level") == "warning").select("path", "page", "level", "message")
