import corpus_pipeline

SF = "/root/testdata/sf0.001"


def shingle_set(text, words=5):
    w = bytes(text or "", "utf-8").lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows):
    """Ids that stay when all pairs are compared on five words: the least of every group."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(k, least.get(root(i), k))
    return sorted(least.values())


def test_stage_is_five_word_brute_force(spark, sample):
    rows = [tuple(r) for r in sample.select("doc_id", "text").collect()]
    kept = corpus_pipeline.near_dedup(spark, sample, SF).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == brute(rows)


def test_stage_keeps_what_only_four_words_call_alike(spark):
    words = [f"w{i}" for i in range(85)]
    edited = list(words)
    for at in (30, 60):  # 74/90 = 0.82 on four words, 71/91 = 0.78 on five
        edited[at] = f"x{at}"
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in enumerate((words, edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r[0] for r in corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()) == [0, 1]
