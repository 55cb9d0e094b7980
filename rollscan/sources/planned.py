"""T1 + S1 with planned partitions: a file reader that opens each file inside its task.

``plan_reads`` takes ``(path, length)`` rows, estimates each file's pages from
its length and deals the files, longest first and back and forth, over bins of
about equal pages.  The plan is a small table with one part per bin; file
bytes take no part in it.  ``read_planned`` reads it through a Python data
source with one partition per bin: the task opens its files one by one, runs
the page function (see ``ocr``) and hands on the rows of small files together
(``row_batches``), so a task holds one file and a bounded batch whatever the bin.

With ``known``, the content hashes of files searched before, the same read
decides: a file whose hash may be known is reported by its hash only (level
``known``), any other one is searched right away, so it is read once.  Every
file that was searched without failing also gives a row of level ``read`` with its content hash.

Files are opened by ``open_file(path)``, by default through ``pyarrow.fs``:
local paths, ``hdfs:``, ``s3:``, ``gs:``.  For stores that only Spark reaches,
``ocr_pages`` takes ``binaryFile`` rows instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rollscan.functions.text import basename
from rollscan.operators.ordering import total_order
from rollscan.params import SearchParams
from rollscan.session import checkpoint_dir, ship_package
from rollscan.sources.files import MB, MSG_NOT_PDF, MSG_TOO_LARGE, PDF_MAGIC
from rollscan.sources.ocr import OCR_OUT, PageFn, _err, _run_file, row_batches

# Bytes of a scanned page, about, and the pages of a bin where there are more than the cores ask for.
PAGE_BYTES = 100_000
PAGES_PER_BIN = 256
# Bins for every core, so that tasks which take longer than planned do not wait for each other, and bins at most.
BINS_PER_CORE = 4
MAX_BINS = 100_000

READ_OUT = T.StructType([*OCR_OUT.fields, T.StructField("file_hash", T.StringType())])

OpenFile = Callable[[str], BinaryIO]


def split_uri(path: str) -> tuple[str, str, str]:
    """Scheme (none for local paths), authority and path of a path as Spark lists it (not percent-encoded)."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        local = rest if scheme == "file" else path
        return "", "", "/" + local.lstrip("/") if local.startswith("/") else local
    authority = urlsplit(f"{scheme}:{quote(rest, safe='/@:%[]')}").netloc
    return scheme, authority, rest.removeprefix("//")[len(authority):]


def open_file(path: str, mode: str = "rb") -> BinaryIO:
    """A file of any file system that ``pyarrow.fs`` knows, for reading or writing."""
    scheme, authority, inner = split_uri(path)
    if not scheme:
        return open(inner, mode)
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(f"{scheme}://{authority}{quote(inner)}")
    return fs.open_input_stream(at) if mode == "rb" else fs.open_output_stream(at)


# ---------------------------------------------------------------------------
# Plan
# ---------------------------------------------------------------------------
def estimated_pages(length: str = "length", page_bytes: int = PAGE_BYTES):
    return F.greatest(F.ceil(F.col(length) / F.lit(page_bytes)), F.lit(1)).cast("long")


@dataclass(frozen=True)
class ReadPlan:
    """A written plan: the parts that hold its bins, and what it was made from."""

    parts: tuple[str, ...]
    files: int
    pages: int


def number_of_bins(files: int, pages: int, cores: int) -> int:
    """As many bins as keep the cores busy, more if they would be long; never more than files."""
    return max(1, min(files, max(cores * BINS_PER_CORE, min(MAX_BINS, -(-pages // PAGES_PER_BIN)))))


def plan_bins(files: DataFrame, bins: int | None = None) -> DataFrame:
    """``files(path, length)`` with est_pages and bin: longest first, dealt back and forth over the bins."""
    rows = files.select("path", "length", estimated_pages().alias("est_pages"))
    if bins is None:
        n, pages = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("est_pages"), F.lit(0))).first()
        bins = number_of_bins(n, pages, files.sparkSession.sparkContext.defaultParallelism)
    placed = total_order(rows, F.col("est_pages").desc(), "path", position="_pos")
    at, turn = (F.col("_pos") - 1) % F.lit(bins), F.floor((F.col("_pos") - 1) / F.lit(bins))
    return placed.withColumn("bin", F.when(turn % 2 == 0, at).otherwise(F.lit(bins - 1) - at).cast("int")).drop("_pos")


def plan_reads(files: DataFrame, bins: int | None = None) -> ReadPlan:
    """Write the plan of reading ``files(path, length)``: one part for each bin, in the checkpoint folder."""
    spark = files.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/rollscan-plans/{uuid.uuid4().hex}"
    planned = plan_bins(files, bins)
    planned.repartition("bin").sortWithinPartitions("bin", F.col("est_pages").desc(), "path").write.partitionBy("bin").parquet(root)
    schema = "path string, length long, est_pages long, bin int"
    back = spark.read.schema(schema).option("basePath", root).parquet(root)
    found = back.groupBy(F.input_file_name().alias("part")).agg(F.count(F.lit(1)).alias("files"), F.sum("est_pages").alias("pages")).collect()
    return ReadPlan(tuple(sorted(unquoted(r["part"]) for r in found)), sum(r["files"] for r in found), sum(r["pages"] for r in found))


def unquoted(uri: str) -> str:
    """``input_file_name`` gives a percent-encoded URI."""
    from urllib.parse import unquote

    return unquote(uri)


# ---------------------------------------------------------------------------
# Known content hashes
# ---------------------------------------------------------------------------
class KnownHashes:
    """A set of SHA-256 hashes that a task can ask: exact up to ``EXACT`` of them, a Bloom filter of fixed size beyond.

    A wrong yes only costs a second read of that file; a no is always right.
    """

    EXACT = 500_000
    BITS = 1 << 26
    PROBES = 4

    def __init__(self, exact: np.ndarray | None = None, words: np.ndarray | None = None):
        self.exact, self.words = exact, words

    @classmethod
    def of(cls, hashes: DataFrame, column: str = "file_hash", exact: int = EXACT, bits: int = BITS) -> KnownHashes:
        """From the distinct hashes of a table (hex strings): at most ``exact`` numbers or ``bits`` / 64 words reach the driver."""
        part = lambda i: F.conv(F.substring(F.col(column), 1 + 8 * i, 8), 16, 10).cast("long")
        hashes = hashes.select(column).distinct()
        first = hashes.select((part(0) * F.lit(1 << 31) + F.shiftright(part(1), 1)).alias("h")).limit(exact + 1).toPandas()["h"]
        if len(first) <= exact:
            return cls(exact=np.sort(first.to_numpy(np.int64)))
        probes = F.explode(F.array(*[part(i) % F.lit(bits) for i in range(cls.PROBES)]))
        bit = hashes.select(probes.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word"))
        found = bit.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("mask")).toPandas()
        words = np.zeros(bits // 64, np.int64)
        words[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
        return cls(words=words)

    def may_hold(self, sha256_hex: str) -> bool:
        parts = [int(sha256_hex[8 * i : 8 * i + 8], 16) for i in range(self.PROBES)]
        if self.exact is not None:
            h = parts[0] * (1 << 31) + (parts[1] >> 1)
            at = np.searchsorted(self.exact, h)
            return bool(at < len(self.exact) and self.exact[at] == h)
        bits = len(self.words) * 64
        return all(int(self.words[p % bits // 64]) >> (p % bits % 64) & 1 for p in parts)


# ---------------------------------------------------------------------------
# Read
# ---------------------------------------------------------------------------
@dataclass
class Bin(InputPartition):
    part: str


@dataclass(frozen=True)
class FileReading:
    """How a task reads a file: limits, page function, known hashes, and how files are opened."""

    page_fn: PageFn
    max_bytes: int
    max_mb: int | float
    max_pages: int | None
    known: KnownHashes | None
    opened: OpenFile

    def rows(self, path: str, length: int) -> list[dict]:
        """All rows of one file; whatever fails in it is a row as well."""
        file = path.rsplit("/", 1)[-1]
        failed = lambda error: [_err(path, file, None, "file", f"{file}: {error}")]
        if length > self.max_bytes:
            return failed(MSG_TOO_LARGE.format(max=self.max_mb) % (length / MB))
        try:
            with self.opened(path) as f:
                content = f.read()
        except OSError as e:
            return failed(f"cannot be read: {e}")
        if content[: len(PDF_MAGIC)] != PDF_MAGIC:
            return failed(f"{MSG_NOT_PDF}{path}")
        file_hash = hashlib.sha256(content).hexdigest()
        if self.known is not None and self.known.may_hold(file_hash):
            return [_err(path, file, None, "known", None) | {"file_hash": file_hash}]
        rows = _run_file(path, file, content, self.page_fn, self.max_pages)
        if any(r["level"] == "file" for r in rows):  # the file failed: it is not done
            return rows
        return rows + [_err(path, file, None, "read", None) | {"file_hash": file_hash}]


class PlannedReader(DataSourceReader):
    """One partition for each part of the plan."""

    def __init__(self, plan: ReadPlan, how: FileReading):
        self.plan, self.how = plan, how

    def partitions(self) -> list[Bin]:
        return [Bin(p) for p in self.plan.parts]

    def read(self, partition: Bin) -> Iterator[pa.RecordBatch]:
        import io

        import pyarrow.parquet as pq

        with open_file(partition.part) as f:
            listed = pq.read_table(io.BytesIO(f.read()), columns=["path", "length"])
        found = zip(listed["path"].to_pylist(), listed["length"].to_pylist())
        yield from row_batches(([{"file_hash": None} | r for r in self.how.rows(path, length)] for path, length in found), READ_OUT)


def planned_source(plan: ReadPlan, how: FileReading) -> type[DataSource]:
    """A data source of its own for one plan (its name is the plan's)."""
    title = f"rollscan_read_{uuid.uuid4().hex}"

    class PlannedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> T.StructType:
            return READ_OUT

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return PlannedReader(plan, how)

    return PlannedFiles


def read_planned(
    files: DataFrame,
    page_fn: PageFn,
    params: SearchParams | None = None,
    known: KnownHashes | None = None,
    bins: int | None = None,
    opened: OpenFile = open_file,
) -> DataFrame:
    """T1 over ``files(path, length)``: the rows of ``ocr_pages`` and, by file, its content hash (levels ``read``, ``known``)."""
    spark: SparkSession = files.sparkSession
    params = params or SearchParams()
    ship_package(spark)
    plan = plan_reads(files.select("path", "length"), bins)
    if not plan.parts:
        return spark.createDataFrame([], READ_OUT)
    limit = float(params.max_pdf_size_mb)
    max_pages = None if params.max_pdf_pages is None else int(params.max_pdf_pages)
    source = planned_source(plan, FileReading(page_fn, int(limit * MB), params.max_pdf_size_mb, max_pages, known, opened))
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


def file_sizes(files: DataFrame) -> DataFrame:
    """``(path, length)`` of ``binaryFile`` rows; the scan then lists files and reads none."""
    return files.select("path", "length")


def read_files(ocr_out: DataFrame) -> DataFrame:
    """``(path, file_hash)`` of the files that were searched."""
    return ocr_out.where(F.col("level") == "read").select("path", "file_hash")


def known_files(ocr_out: DataFrame) -> DataFrame:
    """``(path, file, file_hash)`` of the files whose hash may be known; they were not searched."""
    return ocr_out.where(F.col("level") == "known").select("path", basename(F.col("path")).alias("file"), "file_hash")
