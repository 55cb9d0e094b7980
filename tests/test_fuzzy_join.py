"""J1 against a brute-force Python scorer (both strategies, several thresholds)."""

import random

import pytest
from pyspark.sql import functions as F

from brute import common, matches, token_set
from rollscan.functions.similarity import indel_ratio, lcs, lcs_of_block, lcs_of_many, sketch, sketch_within, token_set_ratio
from rollscan.operators.fuzzy_join import fuzzy_join
from rollscan.params import SearchParams

ALPHA = ["র", "হ", "ি", "ম", "ক", "আ", "ল", "ী", "্", "ঃ", "a", "b"]
SEPS = [" ", " ", " ", "\t", " ", " "]


def _rand_name(r: random.Random) -> str:
    words = []
    for _ in range(r.choice([1, 1, 1, 2, 2, 3])):
        words.append("".join(r.choice(ALPHA) for _ in range(r.randint(1, 6))))
    out = words[0]
    for w in words[1:]:
        out += r.choice(SEPS) + w
    if r.random() < 0.1:
        out = " " + out + "।"
    return out


@pytest.fixture(scope="module")
def cases():
    r = random.Random(7)
    names = [_rand_name(r) for _ in range(300)] + ["", "।", "ঃ ্"]
    queries = [_rand_name(r) for _ in range(40)] + [names[3], names[3], "", "্"]
    return names, queries


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
@pytest.mark.parametrize("threshold", [0, 5, 50, 70, 82, 100])
def test_fuzzy_join_equals_brute_force(spark, cases, strategy, threshold):
    names, queries = cases
    rec = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "rid int, name string")
    qs = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_pos int, query string")
    got = fuzzy_join(rec, qs, SearchParams(threshold=threshold, strategy=strategy))
    got_pairs = sorted((r.rid, r.query_pos) for r in got.select("rid", "query_pos").collect())
    want = sorted(
        (i, j)
        for i, n in enumerate(names)
        for j, q in enumerate(queries)
        if matches(n, q, threshold)
    )
    assert got_pairs == want


def values(spark, fn, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [r.v for r in df.select("i", fn(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]


def test_scores_golden(spark):
    # FIXTURES N2/N4 golden cases
    cases = [("রহিম", "রহিম", 100), ("রহিম", "করিম", 75), ("রহিমআলী", "আলীরহিম", 57.1), ("রহিমআলী", "রহিম", 72.7), ("রহিম\tআলী", "আলী\tরহিম", 100), ("", "x", 0), ("", "", 0)]
    found = values(spark, token_set_ratio, [c[:2] for c in cases])
    assert [round(f, 1) for f in found] == [c[2] for c in cases]
    assert not matches("", "", 80)
    assert not matches("রহিম", "রহীম", 80)
    assert matches("রহিম", "রহিম", 100)
    assert not matches("রহিম", "করিম", 90)
    assert matches("।", "রহিম", 0) and not matches("।", "রহিম", 1)
    assert values(spark, indel_ratio, [("", ""), ("ab", "")]) == [100, 0]
    assert values(spark, lcs, [("smallring", "ringsmall"), ("abcbdab", "bdcaba"), ("", "a")]) == [5, 4, 0]


def test_native_scores_of_strings_of_any_length(spark):
    """Also over several words of the bit-parallel LCS, at their borders, and beyond the basic plane; sketches never exceed the distance."""
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abcআই\U0001f600 \t") for _ in range(n)).strip()
    pairs = [(text(r.choice((0, 1, 8, 61, 62, 63, 124, 125, 200))), text(r.choice((0, 2, 20, 62, 63, 124, 130)))) for _ in range(150)]
    pairs += [(a, a[: len(a) // 2] + text(3) + a[len(a) // 2 :]) for a, _ in pairs[:100]]
    want = [common(a, b) for a, b in pairs]
    assert values(spark, lcs, pairs) == want
    assert [next(lcs_of_many(a, [b])) for a, b in pairs] == want
    assert values(spark, token_set_ratio, pairs) == [100.0 if a == b != "" else token_set(a, b) for a, b in pairs]
    near = lambda a, b: sketch_within(sketch(a), sketch(b), F.length(a) + F.length(b) - 2 * lcs(a, b))
    assert all(values(spark, near, pairs))
    assert values(spark, lambda a, b: sketch_within(sketch(a), sketch(b), F.lit(1)), [("abcd", "wxyz"), ("abcd", "abc")]) == [False, True]


def test_no_cartesian_product_in_plan(spark, cases):
    names, queries = cases
    rec = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "rid int, name string")
    qs = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_pos int, query string")
    from rollscan.operators.fuzzy_join import match_pairs

    for strategy in ("broadcast", "shuffle"):
        for t in (5, 50, 82):
            scoring = match_pairs(rec, qs, t, strategy)
            plan = scoring._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
            assert "Python" not in plan
            joined = fuzzy_join(rec, qs, SearchParams(threshold=t, strategy=strategy))
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("threshold", [75, 82, 90])
def test_shuffle_prefix_filter_on_skewed_bigrams(spark, threshold):
    r = random.Random(threshold)
    stem = "রহিমউদ্দিন"  # every name shares these bigrams
    names = [stem + "".join(r.choice("কখগঘআলী") for _ in range(r.randint(0, 8))) for _ in range(250)]
    names += ["".join(r.choice("কখ") for _ in range(r.randint(2, 20))) for _ in range(50)]
    queries = names[::17] + [stem, stem + "আলী", "কখকখকখ"]
    rec = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "rid int, name string")
    qs = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_pos int, query string")
    got = fuzzy_join(rec, qs, SearchParams(threshold=threshold, strategy="shuffle"))
    got_pairs = sorted((x.rid, x.query_pos) for x in got.select("rid", "query_pos").collect())
    want = sorted(
        (i, j) for i, n in enumerate(names) for j, q in enumerate(queries) if matches(n, q, threshold)
    )
    assert got_pairs == want and len(want) > 0


def test_broadcast_size_check_counts_exploded_keys(spark):
    from rollscan.operators.fuzzy_join import choose_strategy

    qs = spark.createDataFrame([("রহিম আলী",), ("করিম",)], "query string")
    assert choose_strategy(qs, SearchParams()) == "broadcast"
    assert choose_strategy(qs, SearchParams(broadcast_max_bytes=100)) == "shuffle"
    assert choose_strategy(qs, SearchParams(broadcast_max_queries=1)) == "shuffle"
    # low thresholds explode more lengths; the cap at the longest name bounds them
    low = SearchParams(threshold=1, broadcast_max_bytes=20_000)
    assert choose_strategy(qs, low) == "shuffle"
    assert choose_strategy(qs, low, max_len=20) == "broadcast"


def test_hot_name_is_combined_before_the_shuffle(spark):
    r = random.Random(3)
    hot = "রহিম আলী"
    names = [hot] * 600 + [_rand_name(r) for _ in range(1200)]
    queries = ["রহিম", hot, "করিম আলী"]
    rec = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "rid int, name string").repartition(8)
    qs = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_pos int, query string")
    got = fuzzy_join(rec, qs, SearchParams(threshold=70, strategy="broadcast"))
    pairs = sorted((x.rid, x.query_pos) for x in got.select("rid", "query_pos").collect())
    want = sorted((i, j) for i, n in enumerate(names) for j, q in enumerate(queries) if matches(n, q, 70))
    assert pairs == want and sum(1 for i, _ in want if names[i] == hot) >= 600
    from rollscan.operators.fuzzy_join import match_pairs

    plan = match_pairs(rec, qs, 70, "broadcast")._jdf.queryExecution().executedPlan().toString()
    # distinct names: a partial aggregate runs before the exchange (map-side combine)
    assert plan.count("HashAggregate(keys=[_a") >= 2
    # the pair table is small: records are not shuffled for the join back
    final = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final


def test_long_names_cost_in_proportion(spark):
    """Bigram numbering is linear in the length of a name."""
    import time

    from rollscan.operators.fuzzy_join import _forms_of_normalised, _indexed_bigrams

    took = {}
    for n in (100, 400):
        rows = [("".join(chr(97 + (i * j + j * j) % 26) for j in range(n)),) for i in range(2000)]
        names = _forms_of_normalised(spark.createDataFrame(rows, "_a string").distinct(), "_a")
        for _ in range(2):
            t = time.perf_counter()
            _indexed_bigrams(names, "_a").write.format("noop").mode("overwrite").save()
            took[n] = time.perf_counter() - t
    assert took[400] < 10 * took[100] + 2
    few = _forms_of_normalised(spark.createDataFrame([("abab",), ("x",)], "_a string"), "_a")
    got = sorted((r["_a"], r["g"] or "", r["k"]) for r in _indexed_bigrams(few, "_a").collect())
    assert got == [("abab", "ab", 1), ("abab", "ab", 2), ("abab", "ba", 1), ("x", "", 1)]


def test_word_lookup_at_threshold_0_takes_words_of_any_length(spark):
    from rollscan.operators.boxes import best_words

    word = "x" * 5000 + "কখ"
    words = spark.createDataFrame(
        [("p", 1, 0, word, 90.0, (0, 0, 1, 1))],
        "path string, page int, word_pos int, text string, confidence double, bbox struct<left:int,top:int,width:int,height:int>",
    )
    tokens = spark.createDataFrame([("p", 1, 0, "name", 0, "কখ")], "path string, page int, block_pos int, field string, tok_pos int, token string")
    got = best_words(tokens, words, 0, ["path", "page", "block_pos"]).collect()
    assert [r["w_text"] for r in got] == [word]


def test_broadcast_checks_do_not_change_rows(spark, monkeypatch):
    import rollscan.operators.fuzzy_join as fj

    records = spark.createDataFrame([(i, f"name {i % 7} abcd") for i in range(50)], "id int, name string")
    queries = spark.createDataFrame([(f"name {i} abce",) for i in range(9)], "query string")
    run = lambda p: sorted(map(str, fj.fuzzy_join(records, queries, p).collect()))
    want = run(fj.SearchParams(threshold=80))
    assert want and run(fj.SearchParams(threshold=80, broadcast_max_bytes=1)) == want
    monkeypatch.setattr(fj, "BROADCAST_MAX_PAIR_BYTES", 1)
    assert run(fj.SearchParams(threshold=80)) == want


def test_hot_keys_are_split_by_measured_pairs(spark):
    """One name length holds nearly all names: at a threshold that forces no bigram its key is split, rows stay the same."""
    from rollscan.operators.fuzzy_join import _candidates, _forms_of_normalised

    r = random.Random(5)
    names = sorted({"".join(r.choice("abcdef") for _ in range(8)) for _ in range(3000)} | {"ab", "abcdefabcdef", "z\tab"})
    queries = ["".join(r.choice("abcdef") for _ in range(n)) for n in (6, 7, 8, 8, 9, 10)] + ["ab\tq"]
    rec = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "rid int, name string")
    qs = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_pos int, query string")
    got = fuzzy_join(rec, qs, SearchParams(threshold=50, strategy="shuffle"))
    pairs = sorted((x.rid, x.query_pos) for x in got.select("rid", "query_pos").collect())
    assert pairs == sorted((i, j) for i, n in enumerate(names) for j, q in enumerate(queries) if matches(n, q, 50))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        a = _forms_of_normalised(rec.select(F.col("name").alias("_a")), "_a")
        b = _forms_of_normalised(qs.select(F.col("query").alias("_b")), "_b")
        cand = _candidates(a, b, 50, broadcast_b=False)
        parts = sorted(n for (n,) in cand.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and parts[-1] <= 3 * parts[len(parts) // 2]


def test_word_queries_on_a_small_table_equal_brute_force(spark, tmp_path):
    """The queries over all words, which at threshold 66 have no SQL form that is fast enough."""
    import re

    import __spark_entry__ as entry

    docs = ["Der alte Bär läuft", "the old bear runs, runs and rans", "ångström angstrom бар барс", None, "x y"]
    asked = ["alter Bar lauft", "angstrom run", "барсы"]
    spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    words = lambda texts: {w for t in texts if t for w in re.findall(r"[^\W\d_]+", t)}
    for name, t in (("fuzzy_words", 82), ("fuzzy_words_shuffled", 82), ("fuzzy_words_t66", 66)):
        got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select("name", "query").collect())
        assert got == sorted((n, q) for n in words(docs) for q in words(asked) if matches(n, q, t)), name


def test_lcs_of_block_equals_lcs(spark):
    """All word sizes, several words with a carry, shared prefixes, strings beyond the kept depth, empty ones."""
    r = random.Random(13)
    text = lambda n: "".join(r.choice("abcআই\U0001f600\t") for _ in range(n))
    for sizes in ((1, 5, 8), (0, 9, 16), (17, 32), (33, 63, 64), (62, 65, 124, 125, 200)):
        block = [text(r.choice(sizes)) for _ in range(30)]
        strings = [text(r.choice((0, 1, 3, 20, 31, 32, 33, 64, 130))) for _ in range(20)]
        strings += [s[:40] + text(20) for s in strings]
        got = {i: [len(b) - int(x) for b, x in zip(block, left)] for i, left in lcs_of_block(strings, block)}
        assert got == {i: [common(s, b) for b in block] for i, s in enumerate(strings)}


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_pairs_without_forced_bigrams_are_scored_by_block(spark, monkeypatch, strategy):
    """Up to threshold 66 no pair of single tokens is scored by itself; blocks of any size give the same rows and scores."""
    import rollscan.operators.fuzzy_join as fj

    r = random.Random(17)
    word = lambda n: "".join(r.choice("abcdeআই") for _ in range(n))
    names = sorted({word(r.choice((1, 3, 6, 8, 8, 8, 90))) for _ in range(150)})
    queries = sorted({word(r.choice((2, 6, 7, 9, 70))) for _ in range(20)})
    rec, qs = (spark.createDataFrame([(v,) for v in x], f"{c} string") for x, c in ((names, "name"), (queries, "query")))
    joined = lambda t: sorted(tuple(x) for x in fj.fuzzy_join(rec, qs, SearchParams(threshold=t, strategy=strategy)).select("name", "query", "score").collect())
    monkeypatch.setattr(fj, "_verify", None)
    for names_in, queries_in in ((1 << 20, 1 << 20), (7, 3)):
        monkeypatch.setattr(fj, "BLOCK_NAMES", names_in)
        monkeypatch.setattr(fj, "BLOCK_QUERIES", queries_in)
        for t in (3, 66):
            score = lambda n, q: 100.0 - 100 * (len(n) + len(q) - 2 * common(n, q)) / (len(n) + len(q))
            assert joined(t) == sorted((n, q, score(n, q)) for n in names for q in queries if matches(n, q, t)), t
