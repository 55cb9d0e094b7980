"""Mixing sources to target weights by a splitting tree over block quotas.

1. Sources, by code point with null last, weigh 1, 2, 3, repeating.  Each
   gets that share of all words as its target, at most ``MAX_EPOCHS`` times
   its own size; the excess is shared again by weight (water filling).
2. A hash of every document spreads a source's documents over its blocks, so
   a block is a random part of the source.  A target of e whole passes and a
   rest takes every block e times and the first blocks once more, up to the
   rest; inside the block where it ends, documents in hash order.  The words
   taken miss the target by half a document at most.
3. The block instances of each source are its exact quota.  A binary tree
   over the output shards splits the quotas: at each node a uniformly random
   part of the node's block tickets goes left, which makes the counts by
   source a multivariate-hypergeometric draw.  Each shard then draws that
   many of the source's block instances, in permuted order and disjoint from
   every other shard's, and is shuffled locally by a hash.

Block and ticket tables have about ``SHARDS * BLOCKS_PER_SHARD`` rows per pass
whatever the input, and only they and the table of sources are broadcast or
put in order; documents are never sorted and their texts never shuffled.
All randomness is hashes of a seed, so reruns agree.

Defined results: null text has size 0; a null source is a source of its own;
null or repeated ``doc_id`` rows are separate documents (equal rows are taken
equally often); an empty table or one without words takes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.llm.common import SPACE_RUN, text_or_empty
from rollscan.session import materialize

SHARDS = 64
BLOCKS_PER_SHARD = 64
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 20_240
UNIT = 1 << 53


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACE_RUN), "")).cast("long")


def place_hash(seed: int) -> Column:
    """The document's place in the random order of its source, in [0, 2^53)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11)


def block_of(place: str, blocks: str) -> Column:
    return F.floor(F.col(place) / F.lit(float(UNIT)) * F.col(blocks)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """source, n (its number by code point, null last), source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("n", F.row_number().over(order)).withColumn(
        "weight", F.get(F.array(*map(F.lit, weights)), (F.col("n") - 1) % len(weights)).cast("double")
    )
    per = per.withColumn("cap", (most * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    here = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here))
    # sources below the level are full; the first one that isn't sets the level of the rest
    free = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    per = per.withColumn("free", F.first(free, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free") * F.col("weight")))
    return per.select("source", "n", "source_size", target.alias("target"))


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Tickets (n, ticket, shard): the quota of each source n split among the shards.

    ``quotas`` has n and quota.  Each level deals every node's tickets in a
    random order: the first part goes to the left half of its shards.
    """
    t = quotas.select("n", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("ticket"))
    t = t.withColumn("low", F.lit(0)).withColumn("high", F.lit(shards))
    for level in range((shards - 1).bit_length()):
        node = Window.partitionBy("low")
        deal = F.row_number().over(node.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "n", "ticket"), "n", "ticket"))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        t = t.withColumn("middle", middle).withColumn("deal", deal).withColumn("all", F.count("*").over(node))
        share = F.round(F.col("all") * (F.col("middle") - F.col("low")) / (F.col("high") - F.col("low")))
        left = (F.col("high") - F.col("low") > 1) & (F.col("deal") <= share)
        right = (F.col("high") - F.col("low") > 1) & ~left
        t = t.select(
            "n", "ticket",
            F.when(right, F.col("middle")).otherwise(F.col("low")).alias("low"),
            F.when(left, F.col("middle")).otherwise(F.col("high")).alias("high"),
        )
    return t.select("n", "ticket", F.col("low").alias("shard"))


@dataclass
class Mix:
    """A fixed mix: ``sources`` and ``blocks`` are small written tables, ``sizes`` one slim row per document."""

    sizes: DataFrame
    sources: DataFrame
    blocks: DataFrame
    seed: int

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with source, size_, place_) with n, source_size, target and shards_, one shard per copy."""
        s = self.sources.select(F.col("source").alias("of_source_"), "n", "source_size", "target", "blocks", "passes", "last_place")
        s = rows.join(s, F.col("source").eqNullSafe(F.col("of_source_"))).drop("of_source_")
        s = s.withColumn("block", block_of("place_", "blocks"))
        copies = F.col("passes") + (F.col("place_") <= F.col("last_place")).cast("int")
        s = s.join(F.broadcast(self.blocks), ["n", "block"], "left")
        shards = F.slice(F.coalesce("block_shards", F.array().cast("array<int>")), F.lit(1), copies)
        return s.withColumn("shards_", shards).drop("block", "blocks", "passes", "last_place", "block_shards")


def plan_mix(
    docs: DataFrame, shards: int = SHARDS, blocks_per_shard: int = BLOCKS_PER_SHARD, most: int = MAX_EPOCHS, seed: int = SEED
) -> Mix:
    """Fix targets, copies and shards; writes the slim size table and the small plan tables."""
    sizes = materialize(
        docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), place_hash(seed).alias("place"))
    )
    targets = materialize(source_targets(sizes, most=most))
    total = F.sum("target").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    words = F.greatest(F.ceil(total / (shards * blocks_per_shard)), F.lit(1))
    passes = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int")
    sources = targets.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / words), F.lit(1)).cast("long"))
    sources = sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    sources = materialize(sources)

    of = sources.select(F.col("source").alias("of_source"), "n", "blocks", "rest")
    rows = sizes.join(of, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("block", block_of("place", "blocks"))
    # words and last place of each block, and where the source's extra pass ends
    filled = rows.groupBy("n", "block").agg(F.sum("size").alias("words"), F.max("place").alias("end"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("n").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    filled = materialize(filled.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))))
    whole = filled.where((F.col("rest") > 0) & (F.col("before") + F.col("words") <= F.col("rest"))).groupBy("n").agg(F.max("end").alias("whole_end"))
    cut = filled.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    cut = cut.groupBy("n").agg(F.min(F.struct("block", "before")).alias("cut")).select("n", "cut.block", "cut.before")
    inside = Window.partitionBy("n").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    tail = rows.join(F.broadcast(cut), ["n", "block"])  # one block of each source
    tail = tail.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    tail = tail.where(F.col("at") + F.col("size") / 2 <= F.col("rest")).groupBy("n").agg(F.max("place").alias("cut_end"))
    ends = sources.select("n").join(whole, "n", "left").join(tail, "n", "left")
    # without any words asked for, nothing is taken once more
    ends = ends.select("n", F.coalesce(F.greatest("whole_end", "cut_end"), F.lit(-1)).alias("last_place"))
    sources = materialize(sources.join(ends, "n"))

    # block instances: every pass over a block, and the extra one where it has documents up to the last place
    first = F.min("place").alias("begin")
    begun = rows.groupBy("n", "block").agg(first).join(F.broadcast(sources.select("n", "passes", "last_place")), "n")
    times = F.col("passes") + (F.col("begin") <= F.col("last_place")).cast("int")
    instances = begun.withColumn("times", times).where("times > 0").select("n", "block", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    instances = materialize(instances)
    tickets = split_tree(instances.groupBy("n").agg(F.count("*").alias("quota")), shards, seed)
    drawn = tickets.withColumn("draw", F.row_number().over(Window.partitionBy("n").orderBy("shard", "ticket")))
    permuted = F.xxhash64(F.lit(seed + 1), "n", "block", "copy")
    instances = instances.withColumn("draw", F.row_number().over(Window.partitionBy("n").orderBy(permuted, "block", "copy")))
    placed = instances.join(drawn.select("n", "draw", "shard"), ["n", "draw"])
    blocks = placed.groupBy("n", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("c"))
    blocks = materialize(blocks.select("n", "block", F.transform("c", lambda c: c["shard"]).alias("block_shards")))
    return Mix(sizes, sources, blocks, seed)


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken and the shard of each copy."""
    mix = plan_mix(docs, **options)
    rows = mix.assign(mix.sizes.withColumnsRenamed({"size": "size_", "place": "place_"}))
    copies = F.size("shards_")
    return rows.select(
        "doc_id", "source", F.col("size_").alias("size"), "source_size", "target",
        copies.alias("copies"), (copies * F.col("size_")).cast("long").alias("taken"), F.col("shards_").alias("shards"),
    )


def mixed_rows(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all columns, once per copy, with shard and shuffle_key.

    Within a shard, ``shuffle_key`` is the order of the local shuffle.
    """
    mix = plan_mix(docs, seed=seed, **options)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), "source", place_hash(seed).alias("place_"))
    out = mix.assign(packed).select("row_", "place_", F.posexplode("shards_").alias("copy_", "shard"))
    key = F.xxhash64(F.lit(seed + 2), "place_", "copy_")
    return out.select("row_.*", "shard", key.alias("shuffle_key"))
