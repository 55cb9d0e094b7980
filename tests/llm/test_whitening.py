import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollscan.llm.whitening import bit_planes, covariance, cross_products, limbs, scatter, whiten, whitened_rows, LIMB_BITS

SCHEMA = "vec_id long, embedding array<float>"


def whole(v):
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return tuple(math.floor(64 * c) + 1_000_000 for c in v)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("x", "n", "v", "component", "deviation", "whitened"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return whiten(df)


def check(rows, found):
    """Against exact fractions: n, deviations, shares, projections on eigenvectors of the fractions' covariance."""
    have = [(i, x) for i, v in rows if (x := whole(v)) is not None]
    width = max(len(x) for _, x in have)
    have = [(i, x + (1_000_000,) * (width - len(x))) for i, x in have]
    fit = sorted({x for _, x in have})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[Fraction(sum(n * n * a[i] * a[j] for a in fit) - n * sums[i] * sums[j], n**3) for j in range(width)] for i in range(width)]
    v = np.array([[float(c) for c in r] for r in cov])
    values = np.linalg.eigvalsh(v)[::-1]
    rank = int((values > values[0] * 1e-12).sum())
    out = [tuple(r) for r in found.select("vec_id", "deviation", "whitened", "n", "explained", "identity_error").collect()]
    assert len(out) == len(have)
    assert sorted((str(i), int(d)) for i, d, *_ in out) == sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in have)
    kept = min(16, rank)
    assert {(r[3], len(r[2]), len(r[4])) for r in out} == {(n, kept, kept)}
    assert np.allclose(out[0][4], values[:kept] / np.trace(v), rtol=1e-9, atol=0) and out[0][5] <= 1e-8
    # whitened columns are uncorrelated with unit variance over the fit list, and belong to their eigenvalue
    by = {}
    for (i, x) in have:
        by.setdefault(str(i), []).append(x)
    pairs = {by[str(r[0])][0]: r[2] for r in out if len(set(by[str(r[0])])) == 1}
    if len(pairs) == n:
        w, x = np.array([pairs[a] for a in fit]), np.array([[float(Fraction(n * c - s, n)) for c, s in zip(a, sums)] for a in fit])
        assert np.allclose(w.T @ w / n, np.eye(kept), atol=1e-6)
        assert np.allclose(x.T @ w / n, (v @ (x.T @ w / n)) / values[:kept], rtol=1e-6, atol=1e-6 * abs(x).max())


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, run(spark, rows))


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)] + [(50 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(20)]
    rows += [(100, None), (101, [float("nan")] * 5), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("-inf")] * 5), (104, [0.5]), (105, [])]
    rows += [(None, [9.0, -9.0, 1.0, 0.0, 0.0]), (0, rows[0][1])]
    check(rows, run(spark, rows))
    each = whitened_rows(run(spark, rows))
    assert each.schema.simpleString() == (
        "struct<vec_id:bigint,component:int,n:bigint,deviation:bigint,whitened:double,explained:double,identity_error:double>"
    )
    assert each.count() == 64 * 5 and each.selectExpr("min(component)", "max(component)").first() == (1, 5)
    for none in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]):
        assert whitened_rows(run(spark, none)).count() == 0


def test_flat_and_far_dimensions(spark):
    rows = [(i, [float(i), 0.0, 2.0 * i, 1e3 * (i % 2)]) for i in range(30)]
    got = run(spark, rows).collect()
    assert len(got) == 30 and all(len(r["whitened"]) == 2 for r in got) and got[0]["identity_error"] < 1e-4
    far = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])]  # beyond a long: at its ends; deviations beyond 38 digits are null
    out = {r["vec_id"]: r["deviation"] for r in whitened_rows(run(spark, far)).collect()}
    assert out[1] is None and out[2] is None and out[3] is not None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 63), (1 << 63) - 1) | st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=70))
def test_scatter_is_exact(rows):
    x = np.array(rows, np.int64)
    sums, products = scatter(x)
    assert [int(s) for s in sums] == [sum(c) for c in zip(*rows)]
    assert [[int(p) for p in r] for r in products] == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    for v in map(int, products.ravel()):
        assert sum(p << (LIMB_BITS * k) for k, p in enumerate(limbs(v))) == v


def test_planes():
    y = np.array([[0, 5], [0, 2], [0, 7]], np.uint64)
    planes, dim, bit = bit_planes(y)
    assert list(zip(dim, bit)) == [(1, 0), (1, 1), (1, 2)] and [int(np.bitwise_count(p).sum()) for p in planes] == [2, 2, 2]
    s, p = cross_products(y)
    assert list(s) == [0, 14] and p.tolist() == [[0, 0], [0, 78]]


@pytest.mark.parametrize("n,s,p", [(2, [3 << 80], [[5 << 160]])])
def test_covariance_of_large_integers(n, s, p):
    assert covariance(n, s, p)[0][0] == float(Fraction((n * p[0][0] - s[0] ** 2), n * n))
