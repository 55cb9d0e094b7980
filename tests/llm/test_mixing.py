import re
from collections import Counter, defaultdict

import pytest

from rollscan.llm.mixing import mixed_rows, mixed_sizes, split_tree

WORD = re.compile("[^\x20\x09-\x0D]+")


def targets(sizes):
    """Water filling by repeated sharing."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total = sum(sizes.values())
    got = dict.fromkeys(names, 0.0)
    free, left = set(names), float(total)
    while left > 1e-9 and free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        left = 0.0
        for s in list(free):
            got[s] += share[s]
            if got[s] >= 3 * sizes[s]:
                left += got[s] - 3 * sizes[s]
                got[s] = float(3 * sizes[s])
                free.discard(s)
    return got


def check(df, rows):
    out = df.collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((k, len(WORD.findall(t or ""))) for k, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken, longest = targets(sizes), defaultdict(int), defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)
        assert 0 <= r["copies"] <= 3 or r["size"] == 0
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 3 * r["size"] and len(r["shards"]) == r["copies"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1, s
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_sample(sample):
    a = check(mixed_sizes(sample), rows_of(sample))
    b = mixed_sizes(sample.repartition(7)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))  # reruns agree, however the rows are dealt


def test_edges(docs, no_docs):
    check(mixed_sizes(docs), rows_of(docs))
    assert mixed_sizes(no_docs).count() == 0
    assert mixed_sizes(no_docs.unionByName(docs.select(no_docs.columns).where("doc_id in (4, 5, 7)"))).selectExpr("sum(taken)").first()[0] == 0


def test_many_small_documents_come_near_their_targets(spark):
    rows = [(i, "w " * (1 + i % 9), "abcdefg"[min(i % 20, 6)]) for i in range(4000)]
    out = check(mixed_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")), rows)
    words = Counter()
    for r in out:
        words.update({s: r["size"] for s in r["shards"]})
    assert len(words) == 64


def test_tree_keeps_quotas_and_balance(spark):
    q = spark.createDataFrame([(1, 1000), (2, 100), (3, 7)], "n int, quota long")
    t = [tuple(r) for r in split_tree(q, 10, 1).collect()]
    assert Counter(n for n, _, _ in t) == {1: 1000, 2: 100, 3: 7} and len(set(t)) == 1107
    shards = Counter(s for _, _, s in t)
    assert set(shards) == set(range(10)) and max(shards.values()) - min(shards.values()) <= 4
    of_two = Counter(s for n, _, s in t if n == 2)
    assert max(of_two.values()) < 30  # hypergeometric, mean 10
    assert t != [tuple(r) for r in split_tree(q, 10, 2).collect()]


def test_rows(sample, docs):
    copies = {r["doc_id"]: r["copies"] for r in mixed_sizes(sample).collect()}
    out = mixed_rows(sample)
    assert out.columns == sample.columns + ["shard", "shuffle_key"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in copies.items() if n})
    assert mixed_rows(docs).columns[: len(docs.columns)] == docs.columns
