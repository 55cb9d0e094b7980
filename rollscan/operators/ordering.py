"""O1 at any size: a row's place in a total order, without sorting in one task.

Rows are range-partitioned by the order columns and sorted inside their
partitions; what is counted in one place is only the rows of each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.session import materialize

# Rows that one range partition should hold, about.
ROWS_PER_PART = 250_000
# ``monotonically_increasing_id`` numbers the rows of a partition in its lower bits.
_LOCAL_BITS = 33


def total_order(rows: DataFrame, *order: str | Column, position: str = "result_pos", parts: int | None = None) -> DataFrame:
    """``rows`` with ``position``, their place from 1 in the order given; a written table.

    Rows that tie in all order columns are told apart by a hash of all their
    columns, so a frequent key is cut into several ranges too; only equal rows
    stay in any order among themselves.  ``parts`` is the number of range
    partitions (by default the shuffle partitions of the session).
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    tie = F.xxhash64(F.to_json(F.struct(*rows.columns)))
    ranged = rows.withColumn("_tie", tie).repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    ranged = materialize(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _LOCAL_BITS)
    # one row per range partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    placed = ranged.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return placed.withColumn(position, F.col("_before") + local + 1).drop("_part", "_at", "_before")


def range_parts(n_rows: int, rows_per_part: int = ROWS_PER_PART) -> int:
    """Number of output parts for so many rows."""
    return max(1, -(-n_rows // rows_per_part))
