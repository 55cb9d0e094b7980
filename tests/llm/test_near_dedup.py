import random
from collections import defaultdict

import numpy as np
import pytest

from rollscan.llm import near_dedup, queries
from rollscan.llm.near_dedup import band_keys, components, drop_near_duplicates, near_duplicates, shingles


def shingle_set(text, words=5):
    w = bytes((text or ""), "utf-8").lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def brute(rows, words=5):
    """component of every (position) row by comparing all pairs."""
    sets = [shingle_set(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)].append(k)
    return [min(least[root(i)], default=None) for i in range(len(rows))], [len(s) for s in sets]


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def expected(rows, words=5):
    comp, n = brute(rows, words)
    return sorted(((k, c, m, k == m if m is not None and k is not None else m is None) for (k, _), m, c in zip(rows, comp, n)), key=str)


def test_edge_rows(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs)) == expected(rows)


def test_empty(no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert drop_near_duplicates(no_docs).count() == 0


def test_sample(sample):
    rows = [tuple(r) for r in sample.select("doc_id", "text").collect()]
    for words in (4, 5):
        assert result(near_duplicates(sample, words=words)) == expected(rows, words)


def test_query_takes_four_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = queries.op2_minhash_near_dedup(spark, "/root/testdata/sf0.001")
    assert result(found) == expected([tuple(r) for r in docs.collect()], 4)


def edited(words, rng, share):
    return [rng.choice(["zeta", "eta", "theta"]) + str(rng.random()) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_hubs_and_shared_passages(spark, seed):
    """Copies of one hub that are not alike among themselves, chains, and groups that share half a text."""
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    hub = new(300)
    texts += [edited(hub, rng, 0.025) for _ in range(40)] + [hub]
    chain = new(200)
    for _ in range(30):
        chain = chain[6:] + new(6)
        texts.append(list(chain))
    passage = new(150)
    texts += [passage + new(100) for _ in range(40)]
    texts += [t + ["end"] for t in texts[-5:]]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(found) == expected(rows)


def test_pairs_of_a_template_family_grow_with_its_size(spark, monkeypatch):
    """Documents that share a template and differ in a few slots: pairs to confirm for each stay as many, links are all kept."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(220)]

    def family(n):
        rows = []
        for i in range(n):
            words = list(template)
            for at in rng.sample(range(220), rng.choice((2, 4, 6, 9))):
                words[at] = f"w{rng.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        return rows

    seen = []
    whole = near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, sets, percent: seen.append(pairs.count()) or whole(pairs, sets, percent))
    each = {}
    for n in (150, 600):
        rows = family(n)
        seen.clear()
        found = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
        each[n] = sum(seen) / n
        if n == 150:
            assert found == expected(rows)
    assert each[600] <= 1.5 * each[150] + 2, each


def test_drop_keeps_one_of_each_group(docs, sample):
    kept = sorted(str(r[0]) for r in drop_near_duplicates(docs).select("doc_id").collect())
    # one of 1, 2, 3; one of the repeated 8; documents without words stay
    assert kept == sorted(["1", "4", "5", "None", "7", "8", "9", "10", "11"])
    assert drop_near_duplicates(docs).columns == docs.columns
    comp, _ = brute(rows := [tuple(r) for r in sample.select("doc_id", "text").collect()])
    want = sorted(k for (k, _), c in zip(rows, comp) if k == c)
    assert sorted(r[0] for r in drop_near_duplicates(sample).select("doc_id").collect()) == want


def test_bands_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    missed = 0
    for n in (5, 40, 400):
        for _ in range(100):
            both = rng.integers(0, 2**64, n, dtype=np.uint64)
            extra = rng.integers(0, 2**64, 2 * max(1, n // 8), dtype=np.uint64)
            a = np.unique(np.concatenate([both, extra[: len(extra) // 2]]))
            b = np.unique(np.concatenate([both, extra[len(extra) // 2 :]]))
            missed += not (band_keys(a) == band_keys(b)).any()
    assert missed == 0


def test_shingles_ascii_only_lowering():
    assert len(shingles("A b C d e")) == 1 and (shingles("A b C d e") == shingles("a B c D E")).all()
    assert (shingles("É b c d") != shingles("é b c d")).all()
    assert len(shingles("a\xa0b c")) == 1 and len(shingles(" \t ")) == 0


def test_components(spark):
    edges = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(60) if i % 20] + [(b"900", b"901"), (b"901", b"900"), (b"7", b"7")]
    found = {bytes(r[0]): bytes(r[1]) for r in components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert found[b"020"] == b"001" and found[b"059"] == b"041" and found[b"901"] == b"900" and b"7" not in found
