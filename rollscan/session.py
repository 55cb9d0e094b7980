"""Session helpers for tests, benchmarks and local runs.

Cluster jobs get their session from the platform; these helpers only fill in
settings that are unset.  ``checkpoint_dir`` reads ``spark.checkpoint.dir``
from the session and creates a scratch folder only when it is unset (tests).
"""

from __future__ import annotations

import tempfile
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows that carry whole PDF files are large; keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("rollscan")
    settings = dict(DEFAULT_CONF)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k: str(v) for k, v in conf.items()})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch one only where none is configured and all tasks run in this process."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="rollscan-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def estimated_bytes(df) -> int:
    """Catalyst's size estimate of a plan (file sizes for scans), as for broadcast decisions."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def materialize(df):
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and read it back.

    Used for intermediate tables that a plan reads more than once; it also
    cuts the lineage, so a lost executor re-reads the table instead of
    recomputing it.  (``Dataset.checkpoint`` would compute an unpersisted
    input twice: once for its eager count and once to write the files.)
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/rollscan-tables/{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    for scope in getattr(_SCOPES, "open", ()):
        scope.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Intermediate tables written so far, by application.
_WRITTEN: dict[str, list[str]] = {}


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now.

    Spark's cleaner removes them once the driver has collected the plans that
    made them, which without need of memory may be long after; an operator of
    many steps calls this where a written table has cut the lineage.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Lists of the table scopes that are open in a thread.
_SCOPES = threading.local()


@contextmanager
def table_scope():
    """The paths of the intermediate tables that this thread writes inside the block, as a list that grows."""
    scope: list[str] = []
    _SCOPES.open = [*getattr(_SCOPES, "open", ()), scope]
    try:
        yield scope
    finally:
        _SCOPES.open = [s for s in _SCOPES.open if s is not scope]


def written_tables(spark: SparkSession) -> list[str]:
    """Paths of the intermediate tables that this application has written and not dropped."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_tables(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete intermediate tables (all of this application's by default).

    Results that still read them can no longer be computed: call it when
    their last action is done.
    """
    own = _WRITTEN.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in written_tables(spark) if paths is None else paths:
        if path in own:  # nothing but tables of this application
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            own.remove(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rollscan`` importable on executors (``addPyFile`` of a zip of the package).

    Python UDFs and ``mapInPandas`` functions refer to this package by module
    name; on a cluster the executors need a copy.  The zip is staged on the
    driver only for the upload: Spark serves it to every executor, and no job
    reads or writes data there.  (Jobs submitted with ``--py-files`` already
    ship it; this covers drivers that import the repository directly.)  Done
    once per SparkContext.
    """
    import os
    import zipfile

    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="rollscan-pkg-"), "rollscan.zip")
    with zipfile.ZipFile(out, "w") as zf:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(key)
