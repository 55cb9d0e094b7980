import hashlib
import random

from rollscan.llm.spotsigs import bounds_passed, common_words, edited_likeness, fingerprints, similar_groups, with_next


def next_texts(rows):
    """text of the next row by id (nulls first), then text; after the last, the first."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    return [(a, a_text or "", (order[(i + 1) % len(order)][1] or "")) for i, (a, a_text) in enumerate(order)]


def edited(text, after):
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def check_edits(df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = sorted(((k, len(t), hashlib.sha256(edited(t, n).encode()).hexdigest()) for k, t, n in next_texts(rows)), key=str)
    out = edited_likeness(df).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=str) == want
    for r in out:
        a, b = set(r["fingerprint"].split()), set(r["edited_fingerprint"].split())
        assert r["near_edited"] == (len(a & b) / len(a | b) if a | b else 1.0) and 0 <= r["near_next"] <= 1
    return out


def test_edits(docs, sample, no_docs, spark):
    check_edits(docs)
    out = check_edits(sample)
    long = [r for r in out if r["n_chars"] > 400]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.5
    assert sum(r["near_next"] for r in long) / len(long) < 0.1
    assert edited_likeness(no_docs).count() == 0
    check_edits(spark.createDataFrame([(1, "only the one here")], "doc_id long, text string"))


def test_bounds_are_found_by_halving(spark):
    from bisect import bisect_right

    from pyspark.sql import functions as F

    keys = spark.range(-3, 60)
    for bounds in ([], [5], [0, 1], [3, 9, 27], list(range(0, 50, 7)), list(range(17))):
        got = keys.select("id", bounds_passed(F.col("id"), bounds).alias("n")).collect()
        assert all(r["n"] == bisect_right(bounds, r["id"]) for r in got)


def test_next_over_many_buckets(sample):
    rows = [tuple(r) for r in sample.select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["text"], r["next_text"]) for r in with_next(sample, common_words(sample), bucket_chars=20_000).collect())
    assert got == sorted(next_texts(rows))


def test_spots(spark):
    rows = [(1, "The house of the old man."), (2, "the HOUSE, of the: old man"), (3, None), (4, "?!"), (5, "house man"), (6, "the")]
    found = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), ["the", "of"]).collect()}
    assert found[1]["fingerprint"] == found[2]["fingerprint"] and found[1]["n_spots"] == 2
    assert found[3]["fingerprint"] == found[4]["fingerprint"] == "" and found[5]["n_spots"] == 1 and found[6]["n_spots"] == 1


def test_anchors_come_from_the_corpus(spark):
    texts = ["Der Hund, der lief. Der Hund!"] * 3 + ["1 2 3", "", None, "sehrlangeswortallein " * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert common_words(d, percent=100) == ["der", "hund", "lief", "1", "2", "3"]
    assert common_words(d, most=2, percent=100) == ["der", "hund"] and common_words(d, percent=13) == ["der"]


def test_texts_of_any_language_are_spotted_throughout(spark, sample):
    """Texts of a language that is rare in the corpus, with a common opening and different words after it, are no near-duplicates."""
    rng = random.Random(7)
    letters = "абвгдежзиклмнопрстуфхцчшя"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    opening = "Московская область сегодня рано утром"
    texts = [f"{opening} {' '.join(word() for _ in range(300))}" for _ in range(3)]
    texts.append(texts[0] + " конец")
    rows = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for d in (rows, sample.select("doc_id", "text").unionByName(rows)):
        got = {r["doc_id"]: r["group_id"] for r in similar_groups(d).collect()}
        assert [got[10**6 + i] for i in range(4)] == [10**6, 10**6 + 1, 10**6 + 2, 10**6]
        alike = {r["doc_id"]: r for r in edited_likeness(d).collect()}
        assert all(0.3 < alike[10**6 + i]["near_edited"] < 0.9 for i in range(4)) and alike[10**6]["near_next"] < 0.1
        assert all(r["n_spots"] > 10 for k, r in alike.items() if k >= 10**6)


def test_rows_of_one_id_or_none_over_several_buckets(spark):
    """Hot ids are dealt over buckets: every text has one successor, the order is one round."""
    rows = [(None, f"no id {i} " * 30) for i in range(60)] + [(5, f"five {i} " * 30) for i in range(60)] + [(10 + i, f"own {i} " * 30) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = with_next(d, [], bucket_chars=1000).collect()
    step = {r["text"]: r["next_text"] for r in out}
    ids = dict((t, k) for k, t in rows)
    at, order = out[0]["text"], []
    for _ in rows:
        order.append(ids[at])
        at = step[at]
    assert at == out[0]["text"] and len(out) == len(rows)
    turn = next(i for i in range(180) if order[i] is None and order[i - 1] == 69)
    assert order[turn:] + order[:turn] == [None] * 60 + [5] * 60 + list(range(10, 70))


def test_groups_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(10**5))
    anchor = lambda: rng.choice(["the", "of", "and", "der", "la"])
    texts = []
    for _ in range(12):
        base = [x for _ in range(60) for x in (anchor(), word(), word())]
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, 14)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [texts[0], texts[0], "", None, "?"]
    rng.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {r["doc_id"]: set(r["spots"]) for r in fingerprints(d).collect()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    got = {r["doc_id"]: r["group_id"] for r in similar_groups(d).collect()}
    assert got == {i: root(i) for i in sets}
    assert len(set(got.values())) < len(got)
