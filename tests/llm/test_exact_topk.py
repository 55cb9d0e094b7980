import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollscan.llm import exact_topk
from rollscan.llm.exact_topk import Directory, best_of_rows, lifted, products, search_top, spread_pivots

SCHEMA = "vec_id long, embedding array<float>"
LONG = 1 << 63


def whole(v):
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    return [max(-LONG, min(LONG - 1, math.floor(256 * c))) for c in v]


def brute(rows, every=3, k=5):
    """(query_id, rank, vec_id, score): every row against every query."""
    have = [(i, x) for i, v in rows if (x := whole(v)) is not None]
    out = []
    for at, (q, a) in enumerate(have):
        if q is None or q % every:
            continue
        others = [(-max(-LONG, min(LONG - 1, sum(s * t for s, t in zip(a, b))))  , i is None, i or 0) for j, (i, b) in enumerate(have) if j != at]
        out += [(q, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(others)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def top(spark, rows, every=3, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("x", "uid", "node", "pivot", "score", "rank"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return search_top(df, F.col("vec_id") % every == 0, **more)


def near(seed, n, dims, centres=4):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dims)) * 3
    return [(i, [float(np.float32(c)) for c in at[i % centres] + rng.normal(size=dims) * 0.2]) for i in range(n)]


def test_edges(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.5]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
        (6, [None, 1.0]), (None, [1.0, 2.0]), (None, [-1.0, 0.0]), (9, []), (9, [0.25, -0.25]), (9, [0.25, -0.25]), (12, [-3.0, 1.0]),
    ]
    assert found(top(spark, rows)) == brute(rows)
    assert found(top(spark, rows[:1])) == [] and found(top(spark, rows[:2])) == [(0, 1, 1, 5 * 65536)]
    for none in ([], [(3, None)], [(0, []), (3, [])]):
        assert top(spark, none).count() == 0
    far = [(0, [3e38, 1.0]), (1, [3e38, -2.0]), (2, [-3e38, 0.0]), (3, [1e12, 1e12]), (4, [1e10, 5.0])]
    assert found(top(spark, far, every=1)) == brute(far, every=1)


@pytest.mark.parametrize("values", [1 << 18, 64])
def test_equals_all_pairs(spark, monkeypatch, values):
    """Also with annuli and blocks of few rows, so the rounds stop early."""
    monkeypatch.setattr(exact_topk, "BLOCK_VALUES", values)
    monkeypatch.setattr(exact_topk, "CHUNK_VALUES", values)
    rows = near(5, 500, 6) + [(1000 + i, [2.0, 1.0, 0.0, 0.0, 0.5, 0.5]) for i in range(250)]  # a third are equal
    assert found(top(spark, rows, every=50, pivots=4)) == brute(rows, every=50)


def test_scale_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    got = found(search_top(rows, F.col("vec_id") % 50 == 0))
    assert got == brute([tuple(r) for r in rows.collect()], every=50)


def test_bounds_hold_and_skip():
    x = np.array([v for _, v in near(3, 400, 8)]) * 256 // 1
    x = x.astype(np.int64)
    longest = float((x.astype(float) ** 2).sum(axis=1).max())
    raised = np.column_stack([x.astype(float), lifted(x, longest)])
    pivots = spread_pivots(raised, 4)
    d = Directory(longest, pivots)
    pivot, away = d.nearest(x)
    d.annulus = np.array([p * exact_topk.ANNULI for p in range(4)])
    d.low, d.high = (np.array([f(away[pivot == p]) for p in range(4)]) for f in (min, max))
    bound, s = d.upper_bounds(x), products(x, x)
    for p in range(4):
        assert (bound[:, p] >= s[:, pivot == p].max(axis=1)).all()
    fifth = np.sort(s, axis=1)[:, -5]
    assert (bound < fifth[:, None]).mean() > 0.5  # most annuli are never opened


def test_ties_in_a_block():
    s = np.array([[5, 7, 7, 5, 5], [1, 1, 1, 1, 1], [9, 0, 8, 0, 7]])
    row, col = best_of_rows(s, np.array([-LONG, -LONG, 8]), 3)
    assert list(zip(row, col)) == [(0, 1), (0, 2), (0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (2, 2)]
