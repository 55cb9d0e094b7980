import math
import re
from collections import Counter

import numpy as np
import pytest

from rollscan.llm import ranked_search
from rollscan.llm.ranked_search import QuerySet, Sizes, build_index, corpus_counts, postings, query_sets, rank_documents, terms

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counts = [(i, Counter(words(t))) for i, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, found in asked.items():
        scored = []
        for doc_id, c in counts:
            m = 50 + (50 * sum(c.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in found if t in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_terms():
    text = "Don't Über-ÄPFEL_12\x00\x7f naïve {x}\U0001f600"
    assert [t.decode() for t in terms(text)] == words(text) and terms("") == []


def test_edges(spark, docs, no_docs):
    items = [(1, "the quick FOX"), (2, None), (3, "?!"), (4, "word wörter password"), (None, "fox"), (None, "cat katze"), (4, "Hund"), (5, "nowhere")]
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score", "2 AS rank", "3 AS item")
    want = brute(rows_of(docs, "doc_id", "text"), rows_of(items, "item_id", "text"), 50)
    assert want and found(rank_documents(docs, items)) == want
    assert found(rank_documents(docs, items, k=2)) == brute(rows_of(docs, "doc_id", "text"), rows_of(items, "item_id", "text"), 2)
    assert rank_documents(no_docs, items).count() == 0 and rank_documents(docs, items.limit(0)).count() == 0
    assert rank_documents(docs, items).schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(16, 2_000_000, 2, 1), Sizes(8192, 100, 4, 2)])
def test_equals_scoring_everything(spark, sample, sizes):
    """Also with many blocks and groups, so that bounds skip, and several sets of queries."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert found(rank_documents(sample, items, 5, chars=3000, sizes=sizes)) == brute(rows_of(sample, "doc_id", "text"), rows_of(items, "item_id", "text"), 5)


def test_a_hot_text_and_ties(spark):
    docs = [(i, "common words here") for i in range(300)] + [(300 + i, f"rare{i % 3} common " + "filler " * (i % 5)) for i in range(60)]
    items = [(1, "common rare1"), (2, "common words here filler")]
    got = rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == brute(docs, items, 50)


def test_pair_lists_hold_joint_maxima(spark, sample):
    """Every stored joint maximum is reached by a document of its group, and a pair's bound is below the sum of its single maxima."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    queries = next(query_sets(items))
    blocks = postings(sample, queries.vocabulary)
    queries.weigh(*corpus_counts(blocks))
    tighter = 0
    for row in build_index(blocks, queries, Sizes(group_docs=8)).collect():
        r = {c: np.array(row[c], np.int64) for c in row.asDict() if c != "ids"} | {"ids": np.array(row["ids"]), "missing": np.zeros(len(row["ids"]), bool)}
        block = ranked_search.Block(r, len(queries.vocabulary), len(queries.pairs), 8)
        dense = np.zeros((len(queries.vocabulary) + 1, len(row["ids"])), np.int64)
        for t in row["terms"]:
            docs, impact = block.posting(t)
            dense[t, docs] = impact
        group = np.arange(len(row["ids"])) // 8
        for q in queries.queries:
            bound = block.bounds(q)
            both = dense[q.first] + dense[q.second]
            for g in range(block.groups):
                assert (bound[:, g] == both[:, group == g].max(axis=1, initial=0)).all()
            tighter += int((bound < block.tops[block.place[q.first]] + block.tops[block.place[q.second]]).sum())
    assert tighter > 100


def test_weights_of_missing_terms():
    q = QuerySet([(1, [b"a", b"b"]), (2, [b"c"])])
    q.weigh(4, 10, {0: 2})
    assert len(q.queries[0].first) == 1 and q.queries[0].second[0] == -1 and not len(q.queries[1].first)
