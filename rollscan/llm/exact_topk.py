"""Exact top-k search by inner product over a pivot-distance index.

1. Components become integers (``floor(256 * x)``).  With one more component
   that brings every vector to the length of the longest, the largest inner
   product is the smallest distance.
2. Index: every vector is keyed by its nearest pivot and its distance from it.
   Each pivot's vectors are cut by distance into annuli of about equal counts,
   and an annulus into blocks that each hold ``BLOCK_VALUES`` numbers at most.
   Of equal vectors only the ``k + 1`` rows with the smallest ids enter, as no
   query can have use for another, so a vector that a third of the rows share
   costs no more than any other; equal queries are answered once.
3. Search: for a query at distance d from a pivot, a vector at distance r from
   it is at least ``|d - r|`` away, which bounds its inner product.  Annuli are
   sorted by that bound.  Round by round every query expands to the next of
   them; an annulus whose bound is below the query's k-th score so far is not
   opened, and as they are sorted, neither is any after it.  The last round
   opens all that the bounds leave, so results are exact.
4. A block meets the queries that open it in chunks: one integer matrix product
   each, and only scores that can still enter go on to the merge.

The pivots are spread over a bounded sample of vectors (farthest first); they
decide the cost only, never the result.

Defined results: vectors that are null or hold a null, NaN or infinite
component take no part; a shorter vector counts as ending in zeros; components
and scores beyond the range of a long stand at its end; repeated rows are rows
of their own (a copy of the query's row is a candidate), null ids are
candidates, last among equal scores, and never queries; a query with fewer
than k candidates gets all of them; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.llm.common import prepare
from rollscan.llm.whitening import integer_vectors, matrix
from rollscan.session import materialize

SCALE = 256
#: Numbers in a block of vectors, and in a chunk of queries.
BLOCK_VALUES = 1 << 18
CHUNK_VALUES = 1 << 16
PIVOTS = 32
#: Annuli of a pivot at most, so the directory of annuli has PIVOTS times as many rows at most.
ANNULI = 256
#: Numbers in the sample from which pivots are taken.
SAMPLE_VALUES = 1 << 19
#: Annuli opened after each round but the last, by sorted bound.
ROUNDS = (1, 8)


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors with their further component from every pivot (rows of one more component)."""
    v = np.column_stack([x.astype(np.float64), extra])
    squares = (v**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * v @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """The component that brings vectors to the squared length ``longest``."""
    return np.sqrt(np.maximum(longest - (x.astype(np.float64) ** 2).sum(axis=1), 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of longs, within the range of a long."""
    reach = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if reach < 2.0**53:  # every partial sum is a whole number that a double holds
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    wide = q.astype(object) @ x.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best_of_rows(scores: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores of each row at or above ``least``; earlier columns first among equals."""
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
    row, col = np.nonzero(scores >= least[:, None])
    order = np.lexsort((col, ~scores[row, col], row))  # ~s falls as s rises, without overflow
    row, col = row[order], col[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


def top_rows(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows of each key with the highest score, then the smallest vec_id, nulls last."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return rows.withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= k).drop("place_")


@dataclass
class Directory:
    """What bounds need to know: the pivots, and the range of distances of every annulus."""

    longest: float
    pivots: np.ndarray
    annulus: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivot of every vector, and the distance from it."""
        away = distances(x, lifted(x, self.longest), self.pivots)
        return away.argmin(axis=1), away.min(axis=1)

    def upper_bounds(self, x: np.ndarray) -> np.ndarray:
        """For each query and annulus, a number that no inner product with a vector in the annulus exceeds."""
        away = distances(x, np.zeros(len(x)), self.pivots)[:, self.annulus // ANNULI]
        gap = np.maximum(np.maximum(self.low - away, away - self.high), 0)
        size = (x.astype(np.float64) ** 2).sum(axis=1)[:, None] + self.longest
        bound = (size - gap**2) / 2 + 1e-7 * (size + 1)  # more than the rounding of doubles
        return np.maximum(bound, -(2.0**63))  # as scores end there


class PivotIndex:
    """Blocks of vectors by annulus, and the directory that bounds them."""

    def __init__(self, vectors: DataFrame, k: int, pivots: int = PIVOTS) -> None:
        """``vectors`` has uid, vec_id, node (digest of x) and x, and is a written table."""
        self.spark, self.k = vectors.sparkSession, k
        order = Window.partitionBy("node").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
        few = materialize(vectors.withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= k + 1).drop("place_"))
        square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
        longest, self.dims, rows = few.agg(F.max(square), F.max(F.size("x")), F.count("*")).first()
        self.empty = not rows or not self.dims
        if self.empty:
            return
        sample = few.orderBy(F.xxhash64("node", "uid")).limit(max(pivots, SAMPLE_VALUES // self.dims)).select("x").toPandas()["x"]
        sample = np.array([np.asarray(v, np.int64) for v in sample])
        chosen = spread_pivots(np.column_stack([sample.astype(np.float64), lifted(sample, longest)]), pivots)
        self.directory = Directory(longest, chosen)
        self._cut(few, max(64, BLOCK_VALUES // self.dims), rows)

    def _cut(self, few: DataFrame, block_rows: int, rows: int) -> None:
        """Vectors to annuli by distance, annuli to blocks of about so many rows."""
        directory = self.directory

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    pivot, away = directory.nearest(matrix(b.column("x")))
                    yield b.append_column("pivot", pa.array(pivot, pa.int32())).append_column("distance", pa.array(away))

        keyed = materialize(few.mapInArrow(key, few.schema.simpleString()[7:-1].replace(":", " ") + ", pivot int, distance double"))
        annuli = int(min(ANNULI, max(1, rows // (len(directory.pivots) * block_rows))))
        share = [i / annuli for i in range(1, annuli)]
        cuts = F.percentile_approx("distance", share, 20 * annuli) if share else F.first(F.array().cast("array<double>"))
        by_pivot = keyed.groupBy("pivot").agg(cuts.alias("cuts"))  # PIVOTS rows
        inside = F.size(F.filter("cuts", lambda c: c <= F.col("distance")))
        cut = keyed.join(F.broadcast(by_pivot), "pivot").withColumn("annulus", F.col("pivot") * ANNULI + inside)
        found = cut.groupBy("annulus").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).collect()
        found.sort(key=lambda r: r["annulus"])  # at most PIVOTS * ANNULI rows
        directory.annulus, directory.low, directory.high = (np.array([r[c] for r in found]) for c in ("annulus", "low", "high"))
        self.parts = self.spark.createDataFrame([(r["annulus"], -(-r["n"] // block_rows)) for r in found], "annulus int, parts long")
        block = F.pmod(F.xxhash64("uid"), F.col("parts")).alias("part")
        member = F.struct(F.col("vec_id").isNull().alias("unknown"), "vec_id", "uid", "x").alias("m")
        members = cut.join(F.broadcast(self.parts), "annulus").select("annulus", block, member)
        members = members.groupBy("annulus", "part").agg(F.sort_array(F.collect_list("m")).alias("m"))
        self.blocks = materialize(members.select(
            "annulus", "part", F.col("m.vec_id").alias("vec_ids"), F.col("m.uid").alias("uids"), F.flatten("m.x").alias("xs")
        ))

    def opened(self, queries: DataFrame, first: int, last: int | None) -> DataFrame:
        """node, x, least and annulus: the sorted annuli from ``first`` to ``last`` that a query opens."""

        directory = self.directory

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                bound = directory.upper_bounds(matrix(b.column("x")))
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                least = b.column("least").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                live = np.take_along_axis(bound, order, axis=1) >= least[:, None]
                yield b.append_column("annuli", pa.array([directory.annulus[o[v]] for o, v in zip(order, live)], pa.list_(pa.int32())))

        kinds = queries.schema.simpleString()[7:-1].replace(":", " ")
        return queries.mapInArrow(choose, f"{kinds}, annuli array<int>").select("node", "x", "least", F.explode("annuli").alias("annulus"))

    def probe(self, opened: DataFrame, chunks: int) -> DataFrame:
        """node, score, vec_id, uid of the best members of the opened annuli, block by block."""
        k, dims = self.k + 1, self.dims
        pairs = opened.join(F.broadcast(self.parts), "annulus")
        pairs = pairs.select("annulus", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.struct("node", "x", "least").alias("q"))
        chunk = F.pmod(F.xxhash64("q.node"), F.lit(chunks)).alias("chunk")
        asked = pairs.groupBy("annulus", "part", chunk).agg(F.collect_list("q").alias("q"))
        asked = asked.select("annulus", "part", F.col("q.node").alias("nodes"), F.flatten("q.x").alias("qs"), F.col("q.least").alias("least"))
        columns = ["nodes", "qs", "least", "vec_ids", "uids", "xs"]
        met = asked.join(self.blocks, ["annulus", "part"]).select(columns)
        kind = self.blocks.schema["vec_ids"].dataType.elementType.simpleString()

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(len(b)):
                    nodes, qs, least, ids, uids, xs = (b.column(c)[i].values for c in columns)
                    q, x = (v.to_numpy(zero_copy_only=False).reshape(-1, dims) for v in (qs, xs))
                    s = products(q, x)
                    least = least.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                    row, col = best_of_rows(s, least, k)
                    yield pa.RecordBatch.from_arrays(
                        [nodes.take(pa.array(row)), pa.array(s[row, col], pa.int64()), ids.take(pa.array(col)), uids.take(pa.array(col))],
                        ["node", "score", "vec_id", "uid"],
                    )

        return met.mapInArrow(score, f"node binary, score long, vec_id {kind}, uid long")

    def search(self, queries: DataFrame) -> DataFrame:
        """node, score, vec_id, uid: the k + 1 best rows for every query (node, x), a written table."""
        count = queries.count()
        chunks = max(1, count * self.dims // CHUNK_VALUES)
        found, first = None, 0
        for last in (*ROUNDS, None):
            if first >= len(self.directory.annulus):
                break
            if found is None:
                asked = queries.withColumn("least", F.lit(None).cast("long"))
            else:  # a query with k + 1 rows needs no score below the least of them
                least = found.groupBy("node").agg(F.when(F.count("*") > self.k, F.min("score")).alias("least"))
                asked = queries.join(least, "node", "left")
            more = self.probe(self.opened(asked, first, last), chunks)
            found = materialize(top_rows(more if found is None else more.unionByName(found), "node", self.k + 1))
            first = last
        return found


def search_top(rows: DataFrame, is_query: Column, k: int = 5, column: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """The k rows with the highest integer inner products for every row that ``is_query`` (a condition on vec_id) names.

    Returns query_id, rank, vec_id and score; equal scores by vec_id.
    """
    spark = rows.sparkSession
    prepare(spark)
    vectors = integer_vectors(rows, column, scale)
    node = F.unhex(F.md5(F.array_join(F.col("x").cast("array<string>"), ",")))
    vectors = materialize(vectors.select(F.monotonically_increasing_id().alias("uid"), "vec_id", node.alias("node"), "x"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    index = PivotIndex(vectors, k, pivots)
    asking = vectors.where(is_query)
    if index.empty:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    queries = materialize(asking.groupBy("node").agg(F.first("x").alias("x")))
    found = index.search(queries)
    best = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("score").cast("decimal(20,0)")).alias("down"), F.col("vec_id").isNull().alias("unknown"), "vec_id", "uid", "score"
    ))).alias("best"))  # k + 1 at most
    own = asking.select(F.col("vec_id").alias("query_id"), F.col("uid").alias("own"), "node").join(best, "node")
    others = F.slice(F.filter("best", lambda b: b["uid"] != F.col("own")), 1, k)
    each = own.select("query_id", F.posexplode(others).alias("at", "b"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def oracle_sql(k: int = 5, every: int = 50, scale: int = SCALE) -> str:
    """The same scores from all pairs of a query and a row, in DuckDB."""
    return f"""
    WITH vectors AS (
        SELECT vec_id, [floor({scale} * CAST(c AS DOUBLE)) FOR c IN embedding] AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
    ),
    ranked AS (
        SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, v.x) DESC, v.vec_id) AS rank
        FROM vectors q, vectors v WHERE q.vec_id % {every} = 0 AND v.vec_id <> q.vec_id
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {k}
    """
