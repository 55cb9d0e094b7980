from rollscan.llm import queries
from rollscan.llm.spotsigs import edited_likeness, grouped_likeness

SF = "/root/testdata/sf0.001"


def brute(rows):
    """group_id by comparing all pairs of sets; rows of (doc_id, set)."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (k, a) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(rows))]


def check(out):
    rows = out.collect()
    want = brute([(r["doc_id"], set(r["fingerprint"].split())) for r in rows])
    assert [r["group_id"] for r in rows] == want
    return rows


def test_query_groups_all_documents(spark, sample):
    rows = check(queries.op8_spotsigs(spark, SF))
    assert len(rows) == sample.count()
    # near copies that are not neighbours by doc_id
    assert any(r["doc_id"] - r["group_id"] > 1 for r in rows)


def test_rows_of_likeness_stay(docs, no_docs):
    out = grouped_likeness(docs)
    check(out)
    old = edited_likeness(docs)
    assert sorted(map(str, out.drop("group_id").collect())) == sorted(map(str, old.drop("set_key").collect()))
    assert grouped_likeness(no_docs).count() == 0
