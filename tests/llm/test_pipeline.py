from collections import Counter

import corpus_pipeline
from rollscan.llm import queries
from rollscan.llm.mixing import mixed_sizes
from rollscan.llm.near_dedup import near_duplicates
from rollscan.llm.quality_rules import quality_verdicts
from rollscan.llm.secret_scan import find_spans, redact
from rollscan.session import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, sample):
    docs = sample
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, SF))
        ids = Counter(r[0] for r in out.select("doc_id").collect())
        if number < 4:
            assert out.columns == COLUMNS, name
        if number == 0:
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            assert ids == Counter(r[0] for r in quality_verdicts(docs, labels).where("kept").select("doc_id").collect())
        if number == 1:
            assert ids == Counter(r[0] for r in near_duplicates(docs, words=5).where("kept").select("doc_id").collect())
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(r["text"] == before[r["doc_id"]] for r in out.collect())
        if number == 2:
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            for r in out.collect():
                old = before[r["doc_id"]]
                assert r["text"] == redact(old, [(a, b) for _, a, b in find_spans(old)]) and r["n_chars"] == len(r["text"])
        if number == 3:
            want = {r["doc_id"]: r["copies"] for r in mixed_sizes(docs).collect()}
            assert ids == Counter({k: n for k, n in want.items() if n})
        if number == 4:
            assert {"sequence_id", "offset", "length"} <= set(out.columns)
            last = Counter(r[0] for r in docs.select("doc_id").collect())
            assert set(ids) == set(last)
        docs = out
    again = sorted(map(str, queries.pipeline(spark, SF).drop("sequence_id", "offset").collect()))
    assert again == sorted(map(str, out.drop("sequence_id", "offset").collect()))


def test_edge_rows_and_empty_tables(spark, docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0, name
        out = stage(spark, docs, SF)
        assert out.count() > 0 or name == "quality rules", name
        assert name == "packing" or out.columns == COLUMNS, name


def test_queries_are_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in found if k.startswith("op")}
    assert "pipeline" in found and "op6_license_scan" in entry.oracle_sql()
