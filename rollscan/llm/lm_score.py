"""Stupid-backoff language-model scores of all documents by the corpus itself.

The model is the n-gram counts of the whole corpus, without the document
that is scored (its own counts are taken off, so a text is not explained by
itself).  With C the counts left,

    S(w | v) = C(v w) / C(v)            if C(v w) > 0
             = ALPHA * C(w) / N         else, if C(w) > 0
             = ALPHA * 1 / (N + 1)      else (a word that no other document has)

and a document's score is the sum of log S over its words; the first word has
no context and starts at the second line without ALPHA.

Relational plan:

1. Documents are dealt into blocks of about ``BLOCK_CHARS`` by a hash of id and
   text.  Each block's distinct uni- and bigrams (64-bit hashes) with their
   counts are its exploded n-grams, cut by hash range into one row per block
   and hash partition: the counts of a block are combined before anything is
   shuffled, so a frequent n-gram costs one entry per block.
2. The count table of a hash partition is built where all blocks' n-grams of
   that range meet, and joined to them there: each block gets the totals of
   its n-grams back, in its own order.
3. Blocks and their totals are joined by block, and log S is summed per
   document.

Blocks and hash partitions grow with the input, so each task's share is
bounded; what is gathered from the corpus grows with it.

Defined results: words are maximal runs without ASCII white space, A-Z
lower-cased; a null or empty text has 0 words, log score 0 and null mean; a
corpus of one document scores by the last line; repeated or null ``doc_id``
rows are documents of their own; other input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscan.llm.common import prepare, text_or_empty, words_of

ALPHA = 0.4
#: Characters of text in a block, and entries in a hash partition, about.
BLOCK_CHARS = 8 << 20
PART_ENTRIES = 1 << 20

MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def bigram_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * MUL + h[1:])


def block_grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Word hashes of each text; the sorted distinct n-grams of the block and their counts.

    Unigrams are even, bigrams odd, so both are in one table.
    """
    words = [word_hashes(t) for t in texts]
    one = np.uint64(1)
    grams = [h & ~one for h in words] + [bigram_hashes(h) | one for h in words if len(h) > 1]
    keys, counts = np.unique(np.concatenate(grams) if grams else np.empty(0, np.uint64), return_counts=True)
    return words, keys, counts


def arrays(flat: np.ndarray, cuts: np.ndarray) -> pd.Series:
    """Column of arrays: ``flat`` split at the cuts; no rows if it is empty."""
    parts = np.split(flat, cuts) if len(flat) else []
    out = np.empty(len(parts), object)
    for i, part in enumerate(parts):
        out[i] = part
    return pd.Series(out, dtype=object)


def gather(blocked: DataFrame, bits: int) -> DataFrame:
    """block, part, grams and their counts in the block: a row for each hash range that the block has n-grams in."""

    def build(batch: pd.DataFrame) -> pd.DataFrame:
        _, keys, counts = block_grams(batch["text"].tolist())
        part = (keys >> np.uint64(64 - bits)) if bits else np.zeros(len(keys), np.uint64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        rows = {
            "block": batch["block"].iloc[0],
            "part": part[np.concatenate([[0], cuts])[: len(keys)]].astype(np.int64),
            "grams": arrays(keys.view(np.int64), cuts),
            "n": arrays(counts.astype(np.int32), cuts),
        }
        return pd.DataFrame(rows)

    return blocked.groupBy("block").applyInPandas(build, "block long, part long, grams array<long>, n array<int>")


def totals(gathered: DataFrame) -> DataFrame:
    """block, part, total: the corpus counts of each block's n-grams in the order of the block."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        grams = np.concatenate([np.asarray(g) for g in rows["grams"]])
        n = np.concatenate([np.asarray(c) for c in rows["n"]]).astype(np.int64)
        keys, at = np.unique(grams, return_inverse=True)  # the count table of this hash range
        table = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
        ends = np.cumsum([len(g) for g in rows["grams"]])[:-1]
        return pd.DataFrame({"block": rows["block"], "part": rows["part"], "total": arrays(table[at], ends).set_axis(rows.index)})

    return gathered.groupBy("part").applyInPandas(count, "block long, part long, total array<long>")


def log_scores(h: np.ndarray, lookup, words_in_corpus: int) -> tuple[float, int]:
    """Sum of log S over the words of one document, and how many backed off.

    ``lookup`` gives the corpus counts of n-gram keys.
    """
    one = np.uint64(1)
    uni, uni_at, uni_own = np.unique(h & ~one, return_inverse=True, return_counts=True)
    c_uni = (lookup(uni) - uni_own)[uni_at]  # without the document itself
    rest = words_in_corpus - len(h)
    p_uni = np.where(c_uni > 0, c_uni / max(rest, 1), 1.0 / (rest + 1))
    if len(h) == 1:
        return math.log(p_uni[0]), 0
    bi, bi_at, bi_own = np.unique(bigram_hashes(h) | one, return_inverse=True, return_counts=True)
    c_bi = (lookup(bi) - bi_own)[bi_at]
    seen = c_bi > 0
    p = np.where(seen, c_bi / np.maximum(c_uni[:-1], 1), ALPHA * p_uni[1:])
    return math.log(p_uni[0]) + float(np.log(p).sum()), int((~seen).sum())


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_backoff, log_score (natural) and mean_log_score."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select(F.col("doc_id").cast("string"), text_or_empty().alias("text"))
    chars, words_in_corpus = d.agg(F.sum(F.length("text").cast("long")), F.sum(F.size(words_of(F.col("text"))).cast("long"))).first()
    chars, words_in_corpus = chars or 0, words_in_corpus or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    # two n-grams for about six characters; the ranges are the leading bits of the hash
    bits = (chars // 3 // PART_ENTRIES).bit_length()
    # both uses of the documents by block are one exchange
    counts = totals(gather(d, bits))
    schema = "doc_id string, n_words long, n_backoff long, log_score double"

    def score(docs: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        words, keys, _ = block_grams(docs["text"].tolist())
        counted = counted.sort_values("part")
        table = np.concatenate([np.asarray(t) for t in counted["total"]]) if len(counted) else np.empty(0, np.int64)
        lookup = lambda k: table[np.searchsorted(keys, k)]
        found = [log_scores(h, lookup, words_in_corpus) if len(h) else (0.0, 0) for h in words]
        return pd.DataFrame({
            "doc_id": docs["doc_id"], "n_words": [len(h) for h in words],
            "n_backoff": [n for _, n in found], "log_score": [s for s, _ in found],
        })

    scored = d.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(score, schema)
    return scored.select(
        F.col("doc_id").cast(kind), "n_words", "n_backoff", "log_score",
        F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"),
    )
