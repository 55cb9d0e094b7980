import math
from collections import Counter

import pytest

from rollscan.llm import lm_score
from rollscan.llm.lm_score import score_documents


def brute(rows):
    docs = [(k, bytes(t or "", "utf-8").lower().split()) for k, t in rows]
    uni, bi = Counter(), Counter()
    for _, w in docs:
        uni.update(w)
        bi.update(zip(w, w[1:]))
    total = sum(uni.values())
    out = []
    for k, w in docs:
        own, own_bi, rest = Counter(w), Counter(zip(w, w[1:])), total - len(w)
        score, back = 0.0, 0
        for i, x in enumerate(w):
            c = uni[x] - own[x]
            p = c / rest if c else 1 / (rest + 1)
            if i:
                pair = (w[i - 1], x)
                c2 = bi[pair] - own_bi[pair]
                if c2:
                    p = c2 / (uni[w[i - 1]] - own[w[i - 1]])
                else:
                    p, back = 0.4 * p, back + 1
            score += math.log(p)
        out.append((str(k), len(w), back, score))
    return sorted(out)


@pytest.mark.parametrize("chars,entries", [(8 << 20, 1 << 20), (20_000, 500)])
def test_against_brute_force(docs, sample, monkeypatch, chars, entries):
    monkeypatch.setattr(lm_score, "BLOCK_CHARS", chars)
    monkeypatch.setattr(lm_score, "PART_ENTRIES", entries)
    for d in (docs, sample):
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_backoff"], r["log_score"]) for r in score_documents(d).collect())
        want = brute([tuple(r) for r in d.select("doc_id", "text").collect()])
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9)


def test_array_columns():
    import numpy as np

    for flat, cuts in (([], []), ([1], []), ([1, 2], [1]), ([1, 2, 3, 4], [2]), ([1, 2, 3], [1])):
        parts = lm_score.arrays(np.array(flat, np.int64), np.array(cuts, int))
        assert [x for p in parts for x in p] == flat and len(parts) == (len(cuts) + 1 if flat else 0)


def test_edges(spark, no_docs):
    assert score_documents(no_docs).count() == 0
    one = score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert one["log_score"] == pytest.approx(math.log(0.4)) and one["n_backoff"] == 1
    empty = score_documents(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert (empty["n_words"], empty["log_score"], empty["mean_log_score"]) == (0, 0.0, None)
