"""Registered queries of the training-data operators: each derives its result columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.llm import exact_topk, license_scan, pipeline as corpus, ranked_search
from rollscan.llm.chat_format import canonical_turns, format_turns, loss_text, parse_formatted
from rollscan.llm.common import table, text_or_empty
from rollscan.llm.lang_id import held_out, identify, learn
from rollscan.llm.lm_score import score_documents
from rollscan.llm.mixing import mixed_sizes
from rollscan.llm.near_dedup import near_duplicates
from rollscan.llm.packing import pack_documents
from rollscan.llm.quality_rules import quality_verdicts
from rollscan.llm.secret_scan import scan_secrets, secret_digest
from rollscan.llm.spotsigs import grouped_likeness
from rollscan.llm.whitening import whiten, whitened_rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document by the rest of the corpus."""
    return score_documents(documents(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents (four-word shingles, Jaccard 0.8)."""
    return near_duplicates(documents(spark, sf_dir), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: base kinds by pattern, further kinds confirmed by structure."""
    return secret_digest(scan_secrets(documents(spark, sf_dir)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, log-likelihood-ratio score and verdict of all documents."""
    return quality_verdicts(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for heterogeneous chat files: each conversation, and number -1, as a JSON record in a layout that can hold it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_or_empty().alias("text"))
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))
    ])).alias("t"))
    extra = extra.select(F.lit(-1).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", said.alias("text"))
    rows = rows.unionByName(extra)
    c = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    text = lambda i: F.get("t", F.lit(i))["text"]
    is_roles = lambda *names: roles == F.array(*map(F.lit, names))
    kind = F.pmod("conv_id", F.lit(3))
    # as in real files, some records have fields besides those that a layout is told by
    number = F.col("conv_id").cast("string").alias("id")
    message = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.array(F.struct(F.lit("f").alias("call"))).alias("tool_calls"))
    plain = F.to_json(F.struct(F.transform("t", message).alias("messages"), number))
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    shared = F.to_json(F.struct(F.transform("t", lambda x: F.struct(name(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")))
    prompt = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    system = F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response")))
    order = F.to_json(F.struct(text(0).alias("instruction"), F.lit("").alias("input"), text(1).alias("output")))
    short = F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("output"), number))
    usual = F.forall(roles, lambda r: r.isin("system", "user", "assistant"))
    record = (
        F.when(is_roles("user", "assistant"), F.when(kind == 0, prompt).when(kind == 1, order).otherwise(short))
        .when(is_roles("system", "user", "assistant") & (kind == 0), system)
        .when(usual & (kind == 1), shared)
        .otherwise(plain)
    )
    return c.select("conv_id", record.alias("record"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted; turns and loss texts are read back from the formatted output."""
    done = format_turns(canonical_turns(chat_records(spark, sf_dir))).select("conv_id", "layout", "formatted", "segments")
    back = done.withColumn("back", parse_formatted(F.col("formatted"))).withColumn("loss", loss_text("segments"))
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that all documents are, or name in one of their lines."""
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document, and the shards they go to."""
    return mixed_sizes(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "shards"
    )


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, how alike they are, and groups of near-duplicates among all documents."""
    return grouped_likeness(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of all documents in sequences of 2048 tokens."""
    return pack_documents(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents; learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for every benchmark item."""
    return ranked_search.rank_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all embeddings, by inner product, for every 50th."""
    return exact_topk.search_top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened along the 16 leading components."""
    return whitened_rows(whiten(table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    return corpus.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_lm_score, op2_minhash_near_dedup, op3_secret_scan, op4_quality_rules, op5_chat_format, op6_license_scan,
        op7_source_mix, op8_spotsigs, op9_best_fit_packing, op10_language_id,
        op11_ranked_search, op12_exact_topk, op13_whitening, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_license_scan": license_scan.oracle_sql(),
        "op11_ranked_search": ranked_search.oracle_sql(),
        "op12_exact_topk": exact_topk.oracle_sql(),
    }
