import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollscan.llm.quality_rules import base_counts, gram_weights, keep_good, quality_verdicts, trusted_ids

WORD = re.compile("[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(twice), n < 10 or 100 * len(twice) > 20 * n)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


def test_counts(docs, sample, spark):
    odd = [(100, "a b c d e f a b c d e x a b c d e"), (101, "x y z v w " * 5), (102, "a\r\nb\na\r\n|<>#\n \n \nb"), (103, "\x0b\x0c a\x1cb"), (104, "\U0001f600 é" * 30)]
    for d in (docs, sample, spark.createDataFrame(odd, "doc_id long, text string")):
        got = sorted((tuple(r) for r in base_counts(d).select("doc_id", *NAMES).collect()), key=str)
        want = sorted(((r["doc_id"], *counts(r["text"])) for r in d.collect()), key=str)
        assert got == want


def test_verdict(docs, sample, labels, no_docs, spark):
    rows = {r["doc_id"]: r for r in quality_verdicts(sample, labels).collect()}
    assert len(rows) == sample.count()
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= -0.1) for r in rows.values())
    truth = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    good = [rows[k] for k, v in truth.items() if v == (1, 0) and rows[k]["n_words"] >= 10]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    kept = {r["doc_id"] for r in keep_good(sample, labels).collect()}
    assert kept == {k for k, r in rows.items() if r["kept"]}
    assert keep_good(docs, labels).columns == docs.columns
    assert quality_verdicts(docs, labels).count() == docs.count()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_verdicts(no_docs, none).count() == 0
    assert {r["score"] for r in quality_verdicts(docs, none).collect()} == {0.0}


def test_weights_are_the_ratio_of_the_multinomials(sample, labels):
    import math

    n = 257
    w = gram_weights(sample, trusted_ids(labels), n).first()["weights"]
    assert len(w) == n
    ids = {r[0] for r in trusted_ids(labels).collect()}
    hashed = sample.select("doc_id", F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+").alias("w"))
    hashed = hashed.select("doc_id", F.transform(F.array_remove("w", ""), lambda x: F.xxhash64(x)).alias("h"))
    raw, target = Counter(), Counter()
    pairs = []
    for r in hashed.collect():
        cells = [h % n for h in r["h"]]
        raw.update(cells)
        target.update(cells if r["doc_id"] in ids else [])
        pairs += [(r["doc_id"] in ids, a, b) for a, b in zip(r["h"], r["h"][1:])]
    bi = sample.sparkSession.createDataFrame(pairs, "t boolean, a long, b long").select("t", F.pmod(F.xxhash64("a", "b"), F.lit(n)).alias("c"))
    for r in bi.collect():
        raw[r["c"]] += 1
        target[r["c"]] += r["t"]
    scale = sum(target.values()) / sum(raw.values())
    assert w == pytest.approx([math.log((target[i] + 8) / (raw[i] * scale + 8)) for i in range(n)])


def test_trusted_sample(spark):
    rows = [(i, 1, 0) for i in range(4000)] + [(5, 0, 0), (6, 1, 1), (None, 1, 0), (7, 1, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r[0] for r in trusted_ids(labels).collect()} == set(range(4000)) - {5, 6}
    assert 300 < trusted_ids(labels, 400).count() < 500
