"""Embedding whitening from an exact scatter matrix, counted bit by bit.

1. Every finite vector becomes integers, ``floor(scale * c) + offset``.  The
   fit list holds each distinct integer vector once, so copies do not weigh.
2. Bit-sliced scatter: a block of rows is shifted by its least value in every
   dimension, and each bit of each dimension is packed over the rows into
   64-bit words.  ``sum of y_i * y_j`` is the sum over bit pairs of
   ``2^(b + c) * popcount(plane_ib & plane_jc)``.  The shift is taken back
   with Python integers, and every task adds one row of 40-bit limbs that
   Spark sums, so no number is ever rounded.
3. The sums are centred as integers, ``n * sum(x_i x_j) - S_i * S_j``, and only
   their quotient by ``n^2`` becomes floating point, for ``eigh``.  What reaches
   the driver has the square of the dimension as its size, whatever the rows.

Defined results: rows whose vector is null or holds a null, NaN or infinite
entry are left out; a vector shorter than the longest counts as ending in
zeros; entries beyond the range of a long stand at its end; repeated rows and
null or repeated ids keep all their rows; components whose eigenvalue is zero
(to rounding) are left out, so equal vectors only, one vector or an empty
table give no rows; a ``deviation`` of 39 digits or more is null; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscan.llm.common import prepare
from rollscan.session import materialize

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Rows whose bit planes are counted at once.
BLOCK_ROWS = 8192
LIMB_BITS, LIMBS = 40, 6
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
#: Eigenvalues below this share of the largest are zero to rounding.
RANK_SHARE = 1e-12


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < inf))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def integer_vectors(rows: DataFrame, column: str, scale: int, offset: int = 0) -> DataFrame:
    """The rows with a finite vector, as vec_id and x (array of longs, all as long as the longest)."""
    most = F.lit(LONG_MAX - offset).cast("long")
    to_long = lambda c: F.least(F.floor(F.lit(float(scale)) * c.cast("double")), most) + F.lit(offset).cast("long")
    v = rows.where(is_finite(F.col(column))).select("vec_id", F.col(column).alias("v"))
    least, longest = v.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    x = F.transform("v", to_long)
    if least != longest:
        x = F.concat(x, F.array_repeat(F.lit(offset).cast("long"), F.lit(longest) - F.size("v")))
    return v.select("vec_id", x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows by dimensions, of a list column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every bit plane in use, and the dimension and bit of each: y has rows by dimensions of unsigned longs."""
    rows, dims = y.shape
    widths = [int(top).bit_length() for top in y.max(axis=0)]
    planes, of_dim, of_bit = [], [], []
    for bit in range(max(widths)):
        used = np.array([d for d in range(dims) if widths[d] > bit])
        ones = ((y[:, used] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(np.pad(ones, ((0, -rows % 64), (0, 0))), axis=0)
        planes.append(np.ascontiguousarray(packed.T).view(np.uint64))
        of_dim.append(used)
        of_bit.append(np.full(len(used), bit))
    if not planes:
        return np.empty((0, 1), np.uint64), np.empty(0, int), np.empty(0, int)
    return np.concatenate(planes), np.concatenate(of_dim), np.concatenate(of_bit)


def cross_products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the columns of unsigned longs, exact, as arrays of Python integers."""
    planes, dim, bit = bit_planes(y)
    dims, count = y.shape[1], len(planes)
    sums, products = np.zeros(dims, object), np.zeros((dims, dims), object)
    if not count:
        return sums, products
    both = np.zeros((count, count), np.int64)
    for k in range(count):
        both[k, k:] = np.bitwise_count(planes[k:] & planes[k]).sum(axis=1, dtype=np.int64)
    both += np.triu(both, 1).T
    # planes in the order of their dimensions, weighted by their bits
    kind = np.int64 if 2 * int(bit.max()) + 2 + len(y).bit_length() < 60 else object
    weight = np.array([1 << int(b) for b in bit], kind)
    spread = np.zeros((dims, count), kind)
    spread[dim, np.arange(count)] = weight
    np.add.at(sums, dim, (np.diagonal(both).astype(kind) * weight).astype(object))
    products += spread.dot(both.astype(kind)).dot(spread.T).astype(object)
    return sums, products


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of columns of longs, exact."""
    low = x.min(axis=0)
    y = x.view(np.uint64) - low.view(np.uint64)  # wraps to the true difference
    sums, products = cross_products(y)
    low, n = low.astype(object), len(x)
    turned = np.outer(low, sums)
    return sums + n * low, products + turned + turned.T + n * np.outer(low, low)


def limbs(v: int) -> list[int]:
    """A Python integer as longs of 40 bits, the last one with the sign."""
    low = [(v >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1) for k in range(LIMBS - 1)]
    return [*low, v >> (LIMB_BITS * (LIMBS - 1))]


def blocks_of(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[np.ndarray]:
    """The vectors x of Arrow batches, in blocks of about so many rows."""
    held, n = [], 0
    for b in batches:
        if len(b):
            held.append(matrix(b.column("x")))
            n += len(b)
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def total_scatter(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and sums of products of the vectors x of ``fit``."""
    upper = np.triu_indices(dims)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for x in blocks_of(batches):
            s, p = scatter(np.ascontiguousarray(x))
            n, sums, products = n + len(x), sums + s, products + p
        if n:
            numbers = [n, *sums, *products[upper]]
            parts = [limbs(int(v)) for v in numbers]
            columns = [pa.array(range(len(numbers)), pa.int32())] + [pa.array([p[k] for p in parts], pa.int64()) for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays(columns, ["at", *(f"limb{k}" for k in range(LIMBS))])

    each = fit.mapInArrow(count, "at int, " + ", ".join(f"limb{k} long" for k in range(LIMBS)))
    found = each.groupBy("at").agg(*[F.sum(f"limb{k}").alias(f"limb{k}") for k in range(LIMBS)]).collect()
    numbers = {r["at"]: sum(r[f"limb{k}"] << (LIMB_BITS * k) for k in range(LIMBS)) for r in found}
    products = [[0] * dims for _ in range(dims)]
    for k, (i, j) in enumerate(zip(*upper)):
        products[i][j] = products[j][i] = numbers.get(1 + dims + k, 0)
    return numbers.get(0, 0), [numbers.get(1 + i, 0) for i in range(dims)], products


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    """Covariance with divisor n: integers are centred first, then divided once."""
    dims = range(len(sums))
    return np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in dims] for i in dims])


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (by column) of the components with variance."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(most, int((values > max(values[0], 0) * RANK_SHARE).sum()))
    return values[:keep], vectors[:, :keep]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as exact integers: longs if they fit, else Python integers."""
    s = np.array(sums, object)
    if int(np.abs(x.astype(np.float64)).max(initial=0)) * n < 1 << 61 and all(abs(v) < 1 << 61 for v in sums):
        return x * np.int64(n) - s.astype(np.int64)
    return x.astype(object) * n - s


def deviations(d: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exact; null beyond 38 digits."""
    far = float(np.abs(d.astype(np.float64)).max(initial=0))
    wide = d if far * far * d.shape[1] < 2.0**62 else d.astype(object)
    return [v if v < 10**38 else None for v in map(int, (wide * wide).sum(axis=1))]


def whiten(
    rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET
) -> DataFrame:
    """One row per finite vector: vec_id, deviation (decimal), whitened (array by component), and of the fit n, explained (array) and identity_error."""
    spark = rows.sparkSession
    prepare(spark)
    vectors = integer_vectors(rows, column, scale, offset)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation decimal(38,0), whitened array<double>, n long, explained array<double>, identity_error double"
    fit = materialize(vectors.select("x").distinct())
    first = fit.select(F.size("x")).first()
    if not first or not first[0]:
        return spark.createDataFrame([], schema)
    n, sums, products = total_scatter(fit, first[0])
    v = covariance(n, sums, products)
    values, axes = principal(v, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    onto = axes / np.sqrt(values)

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S of some rows, and their whitened components."""
        d = centred(x, n, sums)
        return d, (d.astype(np.float64) / n) @ onto

    error = identity_error(fit, project, n, len(values))
    explained = [float(e) for e in values / np.trace(v)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                d, w = project(matrix(b.column("x")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(deviations(d), pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"]
                )

    done = vectors.mapInArrow(apply, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    return done.select(
        "*", F.lit(n).cast("long").alias("n"), F.array(*map(F.lit, explained)).alias("explained"), F.lit(error).alias("identity_error")
    )


def identity_error(fit: DataFrame, project, n: int, components: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured over its rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components + 1, components))
        for x in blocks_of(batches):
            w = project(x)[1]
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "sum"])

    found = fit.mapInArrow(moments, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect()
    total = np.zeros((components + 1) * components)
    for r in found:
        total[r["at"]] = r["sum"]
    total = total.reshape(components + 1, components) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(components)).max())


def whitened_rows(found: DataFrame) -> DataFrame:
    """A row per vector and component, numbered from 1."""
    at = F.col("at") + 1
    each = found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", at.cast("int").alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.get("explained", "at").alias("explained"), "identity_error",
    )
