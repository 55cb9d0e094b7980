import hashlib
import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollscan.llm import queries
from rollscan.llm.chat_format import canonical_turns, escape, fingerprint, format_turns, loss_text, parse_formatted, unescape, unmapped_layouts

CONTROLS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
TEXTS = [
    "", "plain", "\\", "<", "<\\/s>", "<\\\\/s>", "<\\<SYS>>", "<<\\SYS>>", "<</s>", "<<s>", "[[INST]]", "a\n<|im_end|>\nb", "\\<|im_end|>\\",
    "<|im_start|>user\nhi<|im_end|>\n", "%0A%25", "$1\\2", "é\U0001f600\x00", *CONTROLS, "".join(CONTROLS), "\\".join(CONTROLS), "<".join(CONTROLS),
]


def test_escape_is_reversible(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in d.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in CONTROLS)


LAYOUTS = {
    "messages": ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}]}, [("system", "s"), ("user", "q")]),
    "from-value": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]},
                   [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    "prompt": ({"prompt": "q", "response": "a"}, [("user", "q"), ("assistant", "a")]),
    "system-prompt": ({"system": "s", "prompt": "q", "response": None}, [("system", "s"), ("user", "q"), ("assistant", "")]),
    "instruction": ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    "instruction-only": ({"output": "done", "instruction": "do"}, [("user", "do"), ("assistant", "done")]),
    None: ({"something": "else"}, None),
}


def test_layouts(spark):
    rows = [(i, json.dumps(v[0])) for i, v in enumerate(LAYOUTS.values())] + [(90, None), (91, "no json"), (92, "[]"), (93, '{"prompt": 1, "response": {"x": 2}}')]
    d = spark.createDataFrame(rows, "id int, record string").withColumn("turns_", F.lit("clash"))
    out = {r["id"]: r for r in format_turns(canonical_turns(d)).collect()}
    for i, (name, (_, turns)) in enumerate(LAYOUTS.items()):
        assert out[i]["layout"] == name
        assert (out[i]["turns"] and [tuple(t) for t in out[i]["turns"]]) == turns
    for i in (90, 91, 92, 93):
        assert out[i]["layout"] is None and out[i]["turns"] is None and out[i]["formatted"] == ""
    assert canonical_turns(d.limit(0)).count() == 0


def test_fields_besides_the_layout(spark):
    """Further and optional fields leave a record its layout; what no mapping fits is counted by layout."""
    mapped = [
        ({"id": 7, "messages": [{"role": "user", "content": "q", "name": "n", "tool_calls": [{"f": {"a": [1]}}]}]}, [("user", "q")]),
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None, "weight": 0}], "system": "s"}, [("system", "s"), ("user", "q"), ("assistant", "")]),
        ({"conversations": [{"from": "gpt", "value": "a"}], "source": "x", "system": ""}, [("assistant", "a")]),
        ({"prompt": "q", "response": 5, "meta": {"k": 1}}, [("user", "q"), ("assistant", "5")]),
        ({"instruction": "i", "output": "o", "id": "1", "system": "s"}, [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ({"messages": []}, []),
    ]
    lost = [{"messages": [{"role": "user", "content": [{"type": "text"}]}]}, {"messages": [{"role": "user", "content": [{"type": "x"}]}]},
            {"messages": [{"role": "user"}]}, {"prompt": "q", "response": "a", "output": "o"}]
    rows = [(i, json.dumps(r)) for i, r in enumerate([r for r, _ in mapped] + lost)] + [(50, "no json"), (51, None)]
    turned = canonical_turns(spark.createDataFrame(rows, "id int, record string"))
    out = {r["id"]: r["turns"] for r in turned.collect()}
    assert [[tuple(t) for t in out[i]] for i in range(len(mapped))] == [t for _, t in mapped]
    assert all(out[i] is None for i in (*range(len(mapped), len(mapped) + len(lost)), 50, 51))
    assert sorted(r["records"] for r in unmapped_layouts(turned).collect()) == [1, 1, 2, 2]


def test_edges_of_the_query(spark, tmp_path):
    """Null texts, roles and ids, repeated turns, a long text, a clashing column; and an empty table."""
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y"),
            (3, 0, "user", "word </s> " * 40_000), (3, 1, "assistant", "</s>" * 40_000)]
    schema = "conv_id long, turn long, role string, text string"
    for name, some in (("full", rows), ("empty", [])):
        at = tmp_path / name
        spark.createDataFrame([(*r, "clash") for r in some], schema + ", record string").write.parquet(f"{at}/conversations.parquet")
        out = {r["conv_id"]: r for r in queries.op5_chat_format(spark, str(at)).collect()}
        said = defaultdict(list)
        for c, t, role, text in some:
            said[c].append((t, role or "", text or ""))
        said[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
        assert set(out) == set(said)
        for c, turns in said.items():
            turns = sorted(turns)
            loss = "".join(x for _, r, x in turns if r == "assistant")
            assert out[c]["n_turns"] == len(turns) and out[c]["loss_chars"] == len(loss)
            assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            assert out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_fingerprint_is_of_paths_only(spark):
    rows = ['{"a":{"b":[{"c":1,"d":null}]}}', '{"a":{"b":[{"d":"x","c":2.5},{"c":true}]}}', '{"a":{"b":[{"c":1}]}}', '{"a":{"b":{"c":1,"d":2}}}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "r string").select(fingerprint(F.col("r"))).collect()]
    assert got[0] == got[1] and len(set(got)) == 3


def test_format_reads_back(spark):
    turns = [("assistant" if i % 2 else "us%er\n0" if i % 5 == 0 else "user", t) for i, t in enumerate(TEXTS)]
    d = spark.createDataFrame([(json.dumps({"messages": [{"role": r, "content": t} for r, t in turns]}),), ('{"messages":[{"role":"user","content":"x"}]}',)], "record string")
    out = format_turns(canonical_turns(d))
    out = out.select("formatted", parse_formatted(F.col("formatted")).alias("back"), loss_text("segments").alias("loss")).collect()
    assert [tuple(t) for t in out[0]["back"]] == turns
    assert out[0]["loss"] == "".join(t for r, t in turns if r == "assistant")
    assert out[1]["formatted"] == "<|im_start|>user\nx<|im_end|>\n" and out[1]["loss"] == ""


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    said = defaultdict(list)
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        said[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.op5_chat_format(spark, d).collect()
    assert len(rows) == len(said) and all(r["layout"] for r in rows) and len({r["layout"] for r in rows}) >= 4
    for r in rows:
        turns = sorted(said[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), sha(loss))
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in turns))
        assert r["formatted_chars"] >= sum(len(t) for *_, t in turns)
