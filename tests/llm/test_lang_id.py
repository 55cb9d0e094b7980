import zlib
from collections import Counter

import pytest

from rollscan.llm.lang_id import Judge, held_out, identify, learn, sample_passages


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(some):
    found = {r["doc_id"]: r for r in identify(some, learn(some)).collect()}
    truth = {r["doc_id"]: r["lang"] for r in some.collect()}
    test = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(found) == len(truth) and len(test) > 200
    assert sum(found[k]["lang_pred"] == truth[k] for k in test) >= 0.98 * len(test)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_nothing_is_learned_from_held_out_rows(some, spark):
    from pyspark.sql import functions as F

    flags = {r[0]: r[1] for r in some.select("doc_id", held_out(F.col("doc_id"))).collect()}
    assert flags == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in flags}
    spoiled = some.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    spoiled = spoiled.withColumn("text", F.when(held_out(F.col("doc_id")), F.lit("zzz")).otherwise(F.col("text")))
    assert learn(spoiled) == learn(some)
    assert sample_passages(some, passages=5).groupBy("lang").count().selectExpr("max(count)").first()[0] == 5


def test_edges(docs, no_docs, some):
    contents = learn(some)
    found = [tuple(r) for r in identify(docs, contents).collect()]
    assert len(found) == docs.count()
    by = {r[0]: r for r in found}
    assert by[4] == (4, "und", 0.0, True) and by[5] == (5, "und", 0.0, True) and by[7] == (7, "und", 0.0, True)
    assert by[None][1] in contents and by[9][1] in contents
    assert identify(no_docs, contents).count() == 0
    assert {r[1] for r in identify(docs, learn(no_docs)).collect()} == {"und"}
    assert Judge({"aa": b"x"})("hello") == ("aa", 1.0)
    assert Judge(contents)("123 456 !!") == ("und", 0.0)


def test_every_row_equals_a_plain_loop(spark, sample, docs):
    """The documented sample, compressed text by text with zstandard alone."""
    import re

    import zstandard

    for table in (sample, docs):
        taken = {}
        for r in sample_passages(table).collect():
            taken.setdefault(r["lang"], []).append((r["place"], r["passage"]))
        rows = Counter(r["lang"] for r in table.collect() if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2
                       and r["lang"] is not None and re.search(r"[^\W\d_]", r["text"] or ""))
        order = sorted(taken, key=lambda k: (-rows[k], k))
        packers = []
        for k in order:
            content = "\n".join(p for _, p in sorted(taken[k])).lower().encode()
            packers.append(zstandard.ZstdCompressor(
                level=9, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_content_size=False, write_checksum=False, write_dict_id=False,
            ))
        want = []
        for r in table.collect():
            text = r["text"]
            if not re.search(r"[^\W\d_]", text or ""):
                want.append((r["doc_id"], "und", 0.0))
                continue
            data = text.lower().encode()
            sizes = [sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for c in packers]
            best = min(range(len(order)), key=lambda i: (sizes[i], i))
            rest = sorted(sizes[:best] + sizes[best + 1 :])
            want.append((r["doc_id"], order[best], 1 - sizes[best] / rest[0] if rest else 1.0))
        got = [tuple(r) for r in identify(table, learn(table)).select("doc_id", "lang_pred", "score").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_number_of_languages_is_bounded(spark):
    rows = [(i, "word and more words", f"x{i % 7}" if i < 70 else f"dirty{i}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(learn(d, languages=7)) == [f"x{i}" for i in range(7)] and len(learn(d)) == 200
