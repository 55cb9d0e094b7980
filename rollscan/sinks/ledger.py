"""Result ledger: skip files already searched.

The ledger is a Spark table over a shared folder, partitioned by
``names_hash``, ``threshold`` and the UTC day of an entry, and bucketed and
sorted by ``file_hash``.  A lookup prunes to one search's entries and joins
them where they lie: only the small rows of the files asked for are shuffled,
into the table's buckets.  Writes are appends; the newest entry per key wins
on read.

Expiry drops the days that lie wholly beyond the limit and rewrites the one
that it cuts by Spark's dynamic partition overwrite (written aside, put in
place on commit).  An entry that another run appends meanwhile goes to the
day of that run, which expiry does not touch.

Entry key: file content hash, names hash, a digest of every parameter that
changes result rows (``SearchParams.settings``) and the ledger version, so a
run never reuses rows of other settings.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.functions.text import basename
from rollscan.params import SearchParams
from rollscan.schemas import LEDGER, RESULT_ITEM
from rollscan.session import materialize
from rollscan.sources.files import MB, content_hash

KEY = ["file_hash", "names_hash", "settings", "version"]
# Size check for broadcasting paths of hit or missed files: bytes of the paths and of what a row needs besides.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
ROW_BYTES = 64
# Buckets of the ledger table; a part of its layout on disk.
BUCKETS = 64
# Names up to so many bytes are hashed in one aggregate; longer lists are read in order, a part at a time.
NAMES_IN_ONE_ROW = 64 * 1024 * 1024
DAY_MICROS = 86_400_000_000


def file_hashes(files: DataFrame) -> DataFrame:
    """P5 as small rows: ``(path, file_hash)``; the bytes are read once and dropped."""
    return files.select("path", content_hash("content").alias("file_hash"))


def names_hash_expr(query: Column) -> Column:
    """A7 as an aggregate: first 16 hex of SHA-256 over the names sorted by code point (O2), joined by '|'."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(query)), "|"), 256), 1, 16)


def names_hash(queries: DataFrame, query_col: str = "query", most: int = NAMES_IN_ONE_ROW) -> str:
    """A7 of a list of searched names as a literal (for partition pruning of the ledger).

    The value of ``names_hash_expr`` for a list of any size: beyond ``most``
    bytes the names are sorted by Spark and pass the hash function in order, a
    part of the sorted table at a time.
    """
    kept = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("query"))
    size = kept.agg(F.sum(F.octet_length("query") + F.lit(ROW_BYTES))).first()[0] or 0
    if size <= most:
        return kept.agg(names_hash_expr(F.col("query"))).first()[0]
    digest, glue = hashlib.sha256(), b""
    for row in kept.orderBy("query").toLocalIterator(prefetchPartitions=True):
        digest.update(glue + row["query"].encode())
        glue = b"|"
    return digest.hexdigest()[:16]


def ledger_key(file_hash: Column, names_hash_col: Column, params: SearchParams) -> Column:
    """``filehash_nameshash_threshold`` extended with the digest of all result-changing parameters."""
    return F.concat_ws("_", file_hash, names_hash_col, F.lit(str(int(params.threshold))), F.lit(params.settings()))


def ts_literal(now: dt.datetime) -> Column:
    """A run's fixed "now" (UTC if it names no zone) as a timestamp, the same instant in every session zone."""
    now = now.replace(tzinfo=dt.timezone.utc) if now.tzinfo is None else now
    return F.timestamp_micros(F.lit((now - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)))


def oldest_valid(now: dt.datetime, params: SearchParams) -> Column:
    return ts_literal(now) - F.make_dt_interval(F.lit(int(params.ttl_days)))


def valid_predicate(now: dt.datetime, params: SearchParams) -> Column:
    """F12 + F13: same version and ``now − ts <= ttl`` (an entry aged exactly ttl is valid)."""
    oldest = oldest_valid(now, params)
    return (F.col("version") == F.lit(params.ledger_version)) & (F.col("ts") >= oldest)


def newest_per_key(entries: DataFrame) -> DataFrame:
    """Newest entry per key (append-only table: later writes win; ties → larger path)."""
    others = [c for c in entries.columns if c not in KEY]
    latest = entries.groupBy(*KEY).agg(
        F.max_by(F.struct(*others), F.struct("ts", "pdf_path")).alias("e")
    )
    return latest.select(*KEY, "e.*")


def search_entries(entries: DataFrame, nhash: str, params: SearchParams, now: dt.datetime) -> DataFrame:
    """The valid, newest entries of one search (partition-pruned by names hash and threshold)."""
    mine = entries.where(
        (F.col("names_hash") == F.lit(nhash))
        & (F.col("threshold") == F.lit(int(params.threshold)))
        & (F.col("settings") == F.lit(params.settings()))
    )
    return newest_per_key(mine.where(valid_predicate(now, params)))


def split_hits(files: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(result rows of files with a valid entry, files without one).

    ``files`` needs ``path`` and ``file_hash``.  Hit rows take ``file`` from
    the current path, so copies of one file under other names report their
    own name.  Files whose entry holds no results yield no rows but are not
    misses.
    """
    valid = entries.select("file_hash", "results")  # one entry per file hash already
    hits = files.join(valid, "file_hash", "inner")
    rows = hits.select("path", F.explode("results").alias("r")).select(
        "path",
        basename(F.col("path")).alias("file"),
        F.col("r.page").alias("page"),
        F.col("r.name").alias("name"),
        F.col("r.father").alias("father"),
        F.col("r.bbox").alias("bbox"),
        F.col("r.confidence").alias("confidence"),
    )
    misses = files.join(valid, "file_hash", "left_anti")
    return rows, misses


def entries_from_results(
    files: DataFrame,
    results: DataFrame,
    nhash: str,
    num_names: int,
    params: SearchParams,
    now: dt.datetime,
) -> DataFrame:
    """K4 rows: one entry per searched file (also files with zero matches).

    ``files``: ``path, file_hash``; ``results``: result rows with ``path``.
    Each file's rows are gathered into its entry's ``results`` array: one
    file's matches, which grow with its pages and the searched names.
    """
    cols = []
    for f in RESULT_ITEM.fields:
        c = F.col(f.name) if f.name in results.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    per_file = results.groupBy("path").agg(F.collect_list(F.struct(*cols)).alias("results"))
    joined = files.select("path", "file_hash").join(per_file, "path", "left")
    return joined.select(
        "file_hash",
        F.lit(nhash).alias("names_hash"),
        F.lit(int(params.threshold)).alias("threshold"),
        F.lit(bool(params.box_level)).alias("box_level"),
        F.lit(float(params.min_confidence)).alias("min_confidence"),
        F.lit(params.settings()).alias("settings"),
        F.lit(params.ledger_version).alias("version"),
        ts_literal(now).alias("ts"),
        F.col("path").alias("pdf_path"),
        basename(F.col("path")).alias("pdf_name"),
        F.lit(int(num_names)).alias("num_names"),
        F.coalesce(F.col("results"), F.array().cast(f"array<{RESULT_ITEM.simpleString()}>")).alias("results"),
    )


def entry_day() -> Column:
    """UTC day number of an entry's time."""
    return F.floor(F.unix_micros("ts") / F.lit(DAY_MICROS)).cast("int")


def path_bytes(paths: DataFrame) -> int:
    """Size of a table of paths, as a broadcast would hold it."""
    return paths.agg(F.sum(F.octet_length("path") + F.lit(ROW_BYTES))).first()[0] or 0


class Ledger:
    """The ledger table under ``root`` (a shared folder, never a machine-local one on a cluster).

    The folder is all there is to a ledger: a session that opens it declares
    the table over it and finds the partitions that are there.
    """

    def __init__(self, spark: SparkSession, root: str, params: SearchParams | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.params = params or SearchParams()
        self.table = "rollscan_ledger_" + hashlib.sha256(self.root.encode()).hexdigest()[:16]
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(self.root))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in LEDGER.fields)
        place = self.root.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}, day int) USING parquet PARTITIONED BY (names_hash, threshold, day) "
            f"CLUSTERED BY (file_hash) SORTED BY (file_hash) INTO {BUCKETS} BUCKETS LOCATION '{place}'"
        )

    # -- reads -----------------------------------------------------------------
    def entries(self) -> DataFrame:
        """All entries, those of other sessions included."""
        self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def valid(self, nhash: str, now: dt.datetime) -> DataFrame:
        """The valid, newest entries of one search."""
        days = F.col("day") >= F.floor(F.unix_micros(oldest_valid(now, self.params)) / F.lit(DAY_MICROS))
        return search_entries(self.entries().where(days), nhash, self.params, now)

    def lookup(
        self, files: DataFrame, nhash: str, now: dt.datetime, hashes: DataFrame | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """(hit result rows, files to search, still holding ``content``).

        For rows that carry file bytes.  Entries hold result rows, so they are
        never broadcast or shuffled; what decides is small rows of hashes and
        paths, and of the hit and the missed paths the smaller list is broadcast
        (checked by bytes), so file bytes are not shuffled either.  Only when
        both lists are beyond the check do the file rows shuffle; a run then
        reads by plan (``sources.planned``), which needs neither.
        """
        hashes = hashes if hashes is not None else file_hashes(files)
        hits, miss = split_hits(hashes, self.valid(nhash, now))
        miss = materialize(miss.select("path"))
        found = hashes.select("path").join(miss, "path", "left_anti")
        missed, every = path_bytes(miss), path_bytes(hashes)
        if missed <= min(every - missed, BROADCAST_MAX_BYTES):
            return hits, files.join(F.broadcast(miss), "path", "left_semi")
        if every - missed <= BROADCAST_MAX_BYTES:
            return hits, files.join(F.broadcast(found), "path", "left_anti")
        return hits, files.join(miss, "path", "left_semi")

    def misses(self, hashes: DataFrame, nhash: str, now: dt.datetime) -> DataFrame:
        """Files without a valid entry, as ``(path, file_hash)`` rows (no file bytes)."""
        return split_hits(hashes, self.valid(nhash, now))[1].select("path", "file_hash")

    # -- writes ----------------------------------------------------------------
    def _columns(self, entries: DataFrame) -> DataFrame:
        """Entries in the table's column order, dealt as its buckets, so each task writes one bucket."""
        rows = entries.select(*[f.name for f in LEDGER.fields]).withColumn("day", entry_day())
        return rows.repartition(BUCKETS, "file_hash").select(self.spark.table(self.table).columns)

    def append(self, hashes: DataFrame, results: DataFrame, nhash: str, num_names: int, now: dt.datetime) -> None:
        """K4: store one entry per searched file; ``hashes`` holds ``path, file_hash``."""
        new = entries_from_results(hashes.select("path", "file_hash"), results, nhash, num_names, self.params, now)
        self._columns(new).write.insertInto(self.table)

    def _drop_partitions(self, which: DataFrame) -> None:
        """Remove whole partitions (names_hash, threshold, day): few rows, one for each run and day."""
        for r in which.collect():
            spec = f"names_hash='{r['names_hash']}', threshold={r['threshold']}, day={r['day']}"
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION ({spec})")
            self._fs.delete(self._Path(f"{self.root}/names_hash={r['names_hash']}/threshold={r['threshold']}/day={r['day']}"), True)

    def clear(self) -> int:
        """K5: remove all entries; returns how many there were."""
        entries = self.entries()
        n = entries.count()
        self._drop_partitions(entries.select("names_hash", "threshold", "day").distinct())
        return n

    def clear_expired(self, now: dt.datetime) -> int:
        """K6: remove entries older than the TTL; returns how many were removed."""
        oldest = oldest_valid(now, self.params)
        limit = F.floor(F.unix_micros(oldest) / F.lit(DAY_MICROS))
        aged = self.entries().where(F.col("day") <= limit).groupBy("names_hash", "threshold", "day").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") < oldest).alias("expired")
        )
        aged = materialize(aged)  # one row for each run and day
        gone = aged.where("expired > 0")
        self._drop_partitions(gone.where("expired = n"))
        cut = gone.where("expired < n")
        if not cut.isEmpty():
            parts = F.broadcast(cut.select("names_hash", "threshold", "day"))
            stay = self.entries().where(F.col("day") == limit).join(parts, ["names_hash", "threshold", "day"], "left_semi")
            self._overwrite(stay.where(F.col("ts") >= oldest))
        return aged.agg(F.coalesce(F.sum("expired"), F.lit(0))).first()[0]

    def _overwrite(self, entries: DataFrame) -> None:
        """Replace the partitions that the entries are of, and no others."""
        conf, key = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(key)
        conf.set(key, "dynamic")
        try:
            self._columns(entries).write.insertInto(self.table, overwrite=True)
        finally:
            conf.set(key, before)

    def stats(self) -> DataFrame:
        """A5: one row with entry count, stored size in MB, TTL days, location (fixed column names)."""
        size = self._fs.getContentSummary(self._Path(self.root)).getLength()
        return self.entries().agg(F.count(F.lit(1)).alias("total_entries")).select(
            F.lit(self.root).alias("cache_dir"), "total_entries",
            F.lit(size / MB).alias("total_size_mb"), F.lit(int(self.params.ttl_days)).alias("ttl_days"),
        )
