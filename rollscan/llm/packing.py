"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Documents are tokenised once, in parallel, and cut into pieces of at most
``seq_len`` tokens; the piece table (ids and lengths, no texts) is written to
the shared checkpoint folder.  Best-fit decreasing depends on the lengths
only, and these take at most ``seq_len`` values: the driver gets the length
histogram (at most ``seq_len`` rows, whatever the input) and runs best-fit
decreasing on it, with a segment tree over the remaining capacities that
finds the tightest open bin in logarithmic time.  Equal lengths that meet
bins of equal remaining capacity are placed together, with the result that
placing them one by one gives.  Its plan (one row per such group) is joined
back to the pieces on length and rank, so every piece is placed on Spark.

Defined results: a null or empty text is one piece that holds only the
end-of-text id; rows with null or repeated ``doc_id`` are packed like any
other row; an empty table gives an empty result; other input columns are
ignored.  Texts are tokenised whole.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollscan.llm.common import prepare, text_or_empty
from rollscan.session import materialize

SEQ_LEN = 2048
END_ID = 0


class Encoder:
    """Byte-level BPE ids of the public 50k vocabulary.

    The rank file of the vocabulary is read with tiktoken, several times
    faster than the JSON file with tokenizers and with the same ids (tested
    against it).  A text that holds the string of an added token, or that
    tiktoken refuses, goes to tokenizers as it is, which gives added tokens
    their own ids.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers as public
        import tiktoken

        self.json_path = json_path or public.path("byte_bpe_50k.json")
        with open(ranks_path or public.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(self.json_path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", ())]
        self.slow = None

    def ids(self, text: str) -> list[int]:
        if not any(token in text for token in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # a panic of the native library is no Exception
                if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first one takes the remainder."""
    first = n % seq_len or seq_len
    return [(0, min(first, n))] + [(s, seq_len) for s in range(first, n, seq_len)]


def tokenize_pieces(
    docs: DataFrame,
    seq_len: int = SEQ_LEN,
    end_id: int = END_ID,
    with_ids: bool = False,
    json_path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    prepare(docs.sparkSession)
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(json_path, ranks_path)
        for b in batches:
            rows = []
            for key, text in zip(b["doc_id"].astype(object), b["text"]):
                ids = np.array([*encoder.ids(text), end_id], dtype="<u4")
                for i, (start, n) in enumerate(cut(len(ids), seq_len)):
                    part = ids[start : start + n]
                    rows.append((key, i, start, n, zlib.crc32(part.tobytes()), *([part.astype(int)] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pd.DataFrame(rows, columns=names)

    # a null doc_id would turn a batch of integers into floats, so it travels as a string
    slim = slim.withColumn("doc_id", F.col("doc_id").cast("string"))
    return slim.mapInPandas(pieces, schema.replace(f"doc_id {kind}", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast(kind))


class CapacityTree:
    """Segment tree over capacities 1..n that knows which of them some open bin has left."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, present: bool) -> None:
        i = self.leaves + capacity
        self.any[i] = present
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that is present."""
        i = self.leaves + least
        if self.any[i]:
            return least
        while i > 1:  # up to the first right sibling that has one, then down its left side
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_plan(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a length histogram.

    Rows (length, rank_from, rank_to, first_bin, per_bin, used): the pieces of
    that length with a rank in [rank_from, rank_to) fill consecutive bins,
    ``per_bin`` in each, from offset ``used`` on.
    """
    tree, open_bins = CapacityTree(seq_len), defaultdict(list)  # remaining capacity -> [(first bin, number of bins)]

    def keep(capacity: int, first: int, bins: int) -> None:
        if capacity and bins:
            open_bins[capacity].append((first, bins))
            tree.set(capacity, True)

    plan, new_bin = [], 0
    for length in sorted(histogram, reverse=True):
        rank, total = 0, histogram[length]
        while rank < total:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, bins = seq_len, new_bin, -(-(total - rank) // (seq_len // length))
                new_bin += bins
            else:
                first, bins = open_bins[capacity].pop()
                if not open_bins[capacity]:
                    tree.set(capacity, False)
            per_bin = capacity // length
            placed = min(total - rank, bins * per_bin)
            full, rest = divmod(placed, per_bin)
            plan.append((length, rank, rank + placed, first, per_bin, seq_len - capacity))
            keep(capacity - per_bin * length, first, full)
            if rest:
                keep(capacity - rest * length, first + full, 1)
            keep(capacity, first + full + (rest > 0), bins - full - (rest > 0))
            rank += placed
    return plan


def place(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_plan(histogram, seq_len)
    # of one length, as many chunks as rows in a chunk: neither ranking nor adding up is long for a frequent length
    chunks = max(1, math.isqrt(sum(histogram.values())))
    keyed = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    # rank within the length: position inside the chunk plus the rows of the chunks before it
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("local", F.row_number().over(inside) - 1).join(counts, ["length", "chunk"])
    ranked = ranked.withColumn("rank", F.col("local") + F.col("before"))
    columns = ["plan_length", "rank_from", "rank_to", "first_bin", "per_bin", "used"]
    steps = spark.createDataFrame(plan, ", ".join(f"{c} long" for c in columns))
    slot = F.col("rank") - F.col("rank_from")
    return ranked.join(
        F.broadcast(steps),  # a few rows for each of at most seq_len lengths
        (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    ).select(
        *pieces.columns,
        (F.col("first_bin") + F.floor(slot / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("used") + slot % F.col("per_bin") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return place(materialize(tokenize_pieces(docs, seq_len, end_id, with_ids)), seq_len)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (needs ``with_ids``): ids and document starts, at most seq_len of each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["offset"]).alias("starts"),
    )
