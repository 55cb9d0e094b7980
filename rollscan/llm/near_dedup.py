"""Near-duplicate documents by MinHash: one-permutation hashing, bands, star edges.

1. Each text becomes its set of 64-bit word-shingle hashes.  One permutation
   hash splits the set over ``BINS`` bins and keeps the least hash of each;
   an empty bin copies the first filled bin of its own fixed random order
   (optimal densification).  Bands of ``ROWS`` bins give bucket keys; two
   sets with Jaccard 0.8 miss each other in all 80 bands with odds of 4e-7,
   while sets with Jaccard 0.5 share one band in 250.
2. Equal sets become one node, named by the digest of the set, so a group of
   exact copies of any size costs one row after a map-side aggregate.
3. Inside a bucket, candidate edges form a star: every member is tested
   against the centre only, the member with the most company over all its
   buckets.  A bucket of m members gives m - 1 pairs.  Pairs are confirmed on
   the full sets and the links are joined to connected components.
4. Sets in buckets that still hold several components are compared by their
   rarest shingles, one of which two alike sets must share.  First in turns of
   stars, with another centre under each shingle in every turn, as long as they
   join components; then exactly, every pair that is still in two components.
   So no link between sets that share a bucket is lost, and a family of many
   alike sets is one component long before all its pairs would be formed.

Defined results: a null or empty text has an empty set, is linked with
nothing and has its own ``doc_id`` as component; repeated ``doc_id`` rows are
separate documents with their own sets; a null ``doc_id`` does not name a
component while its group has another id, and a group without any id has a
null ``component_id`` and is kept; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.llm.common import prepare, text_or_empty
from rollscan.session import drop_tables, materialize, release_shuffles, table_scope

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
BINS = 640
ROWS = 8
#: Places of its detour that an empty bin tries at first; nearly all find a filled one.
DETOUR = 64
#: Bytes up to which a table of keys is broadcast; beyond, its join shuffles.
BROADCAST_BYTES = 16 << 20
#: Bytes of a row of keys in a broadcast table, with what the table needs for it.
KEY_BYTES = 64
#: Turns of stars over the undecided sets at most, and the share of them that a turn must link for another one.
TURNS, TURN_SHARE = 8, 0.02

MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash over the others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a shorter text is one shingle, no words none."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = len(h) - words + 1
    out = h[:n].copy()
    for k in range(1, words):
        out = out * MUL + h[k : k + n]
    return np.unique(mix(out))


@cache
def detours(bins: int) -> np.ndarray:
    """For every bin a fixed random order of the bins, itself first."""
    rng = np.random.default_rng(20_170)
    return np.array([[i, *rng.permutation([j for j in range(bins) if j != i])] for i in range(bins)])


def band_keys(sorted_set: np.ndarray, bins: int = BINS, rows: int = ROWS) -> np.ndarray:
    """Bucket keys of a non-empty sorted set: one-permutation bins, densified, hashed by band."""
    bin_of = (sorted_set >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)  # by the leading bits, so in order too
    at = np.searchsorted(bin_of, np.arange(bins + 1, dtype=np.uint64))
    filled = at[1:] > at[:-1]
    source, empty, order = np.arange(bins), np.flatnonzero(~filled), detours(bins)
    for tries in (DETOUR, bins):
        on_way = filled[order[empty, :tries]]
        source[empty] = order[empty, np.argmax(on_way, axis=1)]
        empty = empty[~on_way.any(axis=1)]
        if not len(empty):
            break
    grid = sorted_set[at[source]].reshape(-1, rows)
    out = np.arange(len(grid), dtype=np.uint64)
    for k in range(rows):
        out = mix(out * MUL + grid[:, k])
    return out.view(np.int64)


def list_column(parts: list[np.ndarray]) -> pa.Array:
    """Arrow list<int64> column of a list of 64-bit arrays."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if len(parts) and ends[-1] else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def signatures(docs: DataFrame, words: int = SHINGLE_WORDS, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (digest of the set; null if empty) and bands of every document."""
    prepare(docs.sparkSession)
    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_or_empty().alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, words) for t in b.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            bands = [band_keys(s, bins, rows) if len(s) else np.empty(0, np.int64) for s in sets]
            columns = [
                b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.binary()), list_column(bands),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_key", "bands"])

    return slim.mapInArrow(sign, f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """set_key and set (array of shingle hashes) of every document with words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for t in b.column("text").to_pylist() if len(s := shingles(t, words))]
            keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, list_column(sets)], ["set_key", "set"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(build, "set_key binary, set array<long>")


def small(rows: DataFrame, row_bytes: int = KEY_BYTES) -> DataFrame:
    """A written table of keys, marked for broadcast if it is small enough."""
    return F.broadcast(rows) if rows.count() * row_bytes <= BROADCAST_BYTES else rows


def only_keys(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose column is among the keys (one column ``key``, distinct, a written table)."""
    keys = small(keys)
    return rows.join(keys, F.col(column) == F.col("key"), "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node and the least node it reaches, for every node of an edge.

    Alternating large-star and small-star rounds, each written to the
    checkpoint folder, until the edges no longer change.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours hang below the least node of the neighbourhood
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where(F.col("a") != F.col("b")).distinct())
        # small star: smaller neighbours, and the node itself, hang below the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = materialize(small.where(F.col("a") != F.col("b")).distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) with the links (a, b) added; only the roots that they join are looked at again."""
    ends = links.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    rooted = materialize(ends.join(labels, F.col("end") == F.col("node"), "left").select("end", F.coalesce("root", "end").alias("root")))
    of_a = rooted.select(F.col("end").alias("a"), F.col("root").alias("root_a"))
    of_b = rooted.select(F.col("end").alias("b"), F.col("root").alias("root_b"))
    joined = components(links.join(of_a, "a").join(of_b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    joined = joined.select(F.col("node").alias("old"), F.col("root").alias("new"))
    # nodes that had no root yet are their own
    every = labels.unionByName(rooted.where(F.col("end") == F.col("root")).select(F.col("end").alias("node"), "root")).distinct()
    return materialize(every.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")))


def close_enough(percent: int) -> Column:
    """Size bound on a pair: the smaller set must hold that share of the larger one."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) whose full sets reach the Jaccard threshold."""
    keys = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    own = only_keys(sets, "set_key", keys)
    left = own.select(F.col("set_key").alias("a"), F.col("set").alias("set_a"))
    right = own.select(F.col("set_key").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    # a is the centre: its set meets the rows of its members only in the last join
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def undecided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The sets (set_key, n, root) in buckets whose members have several roots."""
    rooted = members.join(labels, F.col("set_key") == F.col("node"), "left")
    rooted = rooted.select("bucket", "set_key", "n", F.coalesce("root", "set_key").alias("root"))
    split = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return materialize(rooted.join(split, "bucket", "left_semi").select("set_key", "n", "root").distinct())


def needed(a: str, b: str, percent: int) -> Column:
    """Least number of common shingles of two alike sets of these sizes."""
    return F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent))


def rare_entries(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Entries (shingle, set_key, n, at) of the live sets under their rarest shingles, a written table.

    With shingles in one common order, the rarest first, two alike sets share
    one among the first ``n - needed + 1`` of each; ``at`` is its place.
    """
    keys = materialize(live.select(F.col("set_key").alias("key")))
    held = only_keys(sets, "set_key", keys).select("set_key", F.explode("set").alias("shingle"))
    often = held.groupBy("shingle").agg(F.count("*").alias("holders"))
    ordered = held.join(often, "shingle").groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("s"))
    # the partner may be as small as percent of n: that is the longest prefix
    longest = F.size("s") - F.ceil(percent * F.size("s") / 100).cast("int") + 1
    first = ordered.select("set_key", F.size("s").cast("long").alias("n"), F.posexplode(F.slice("s", F.lit(1), longest)).alias("at", "e"))
    return materialize(first.where("e.holders > 1").select("e.shingle", "set_key", "n", "at"))


def divided(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries, with roots, under shingles that sets of several roots hold; a written table."""
    rooted = entries.join(small(labels, 2 * KEY_BYTES), F.col("set_key") == F.col("node"), "left")
    rooted = materialize(rooted.select("shingle", "set_key", "n", "at", F.coalesce("root", "set_key").alias("root")))
    split = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return materialize(rooted.join(split.select("shingle"), "shingle", "left_semi"))


def can_link(percent: int) -> Column:
    """Whether sizes and places of a shared shingle leave room for enough common ones after it."""
    need = needed("n_a", "n_b", percent)
    fits = (F.col("at_a") <= F.col("n_a") - need) & (F.col("at_b") <= F.col("n_b") - need)
    return (F.col("root_a") != F.col("root_b")) & close_enough(percent) & fits


def side(x: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{x}") for c in ("n", "root", "at")] + [F.col("set_key").alias(x), F.col("shingle")]


def once(pairs: DataFrame) -> DataFrame:
    """Every pair (a, b, n_a, n_b) in one direction, with its ends as lo and hi."""
    return pairs.select("a", "b", "n_a", "n_b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).dropDuplicates(["lo", "hi"])


def star_pairs(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """One star under every shingle: around a set of the largest component at first, around another one in every turn."""
    sizes = entries.groupBy("root").agg(F.count_distinct("set_key").alias("nodes")) if not turn else None
    ranked = entries.join(sizes, "root") if not turn else entries.withColumn("nodes", F.lit(0).cast("long"))
    top = ranked.groupBy("shingle").agg(F.max(F.struct("nodes", F.xxhash64("set_key", F.lit(turn)).alias("by"), "set_key", "n", "root", "at")).alias("c"))
    centre = top.select("shingle", F.col("c.set_key").alias("a"), *[F.col(f"c.{c}").alias(f"{c}_a") for c in ("n", "root", "at")])
    return once(entries.select(*side("b")).join(centre, "shingle").where(can_link(percent)))


def cross_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Every pair of sets with different roots that can be alike.

    Under each shingle, only sets outside its most frequent root are paired
    with the others, so a large group of one root is never paired with itself.
    """
    sizes = entries.groupBy("root").agg(F.count("*").alias("nodes"))
    top = entries.join(sizes, "root").groupBy("shingle").agg(F.max(F.struct("nodes", "root")).alias("top"))
    left = entries.join(top.select("shingle", F.col("top.root").alias("top")), "shingle").where("root <> top").select(*side("a"))
    return once(left.join(entries.select(*side("b")), "shingle").where(can_link(percent)))


def group_buckets(in_buckets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Groups of similar sets: node and root for every set that is linked to another one, a written table.

    ``in_buckets`` has bucket, set_key and n (set size); pairs that share no
    bucket are not candidates.  ``sets_of`` gets the keys (``set_key``) in
    buckets of two or more and returns their full sets (set_key, set).
    """
    with table_scope() as written:
        labels = materialize(_grouped(in_buckets, sets_of, percent))
    drop_tables(in_buckets.sparkSession, written[:-1])
    release_shuffles(in_buckets.sparkSession)
    return labels


def _grouped(in_buckets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    sizes = in_buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(in_buckets.join(sizes, "bucket"))
    company = members.groupBy("set_key").agg(F.sum("size").alias("weight"))
    members = materialize(members.join(company, "set_key").select("bucket", "set_key", "n", F.struct("weight", "n", "set_key").alias("rank")))
    sets = materialize(sets_of(members.select("set_key").distinct()))
    release_shuffles(in_buckets.sparkSession)

    # a star in every bucket, around the member with the most company
    centres = members.groupBy("bucket").agg(F.max("rank").alias("top"))
    centres = centres.select("bucket", F.col("top.set_key").alias("a"), F.col("top.n").alias("n_a"))
    rest = members.select("bucket", F.col("set_key").alias("b"), F.col("n").alias("n_b"))
    star = materialize(once(rest.join(centres, "bucket").where((F.col("a") != F.col("b")) & close_enough(percent))))
    nothing = in_buckets.sparkSession.createDataFrame([], "node binary, root binary")
    labels = merged(nothing, materialize(confirmed(star, sets, percent)))

    live = undecided(members, labels)
    left = live.count()
    if left:
        release_shuffles(in_buckets.sparkSession)
        tested, entries = star.select("lo", "hi"), rare_entries(live, sets, percent)
        release_shuffles(in_buckets.sparkSession)
        for turn in range(TURNS + 1):
            rooted = divided(entries, labels)
            if rooted.isEmpty():
                break
            last = turn == TURNS or left == 0
            pairs = cross_pairs(rooted, percent) if last else star_pairs(rooted, turn, percent)
            pairs = materialize(pairs.join(tested, ["lo", "hi"], "left_anti"))
            links = materialize(confirmed(pairs, sets, percent))
            labels = merged(labels, links)
            if last:
                break
            tested = tested.unionByName(pairs.select("lo", "hi"))
            # few new links: what is left goes to the exact comparison
            left = left if links.count() >= TURN_SHARE * left else 0
    return labels


def near_duplicates(
    docs: DataFrame, percent: int = THRESHOLD_PERCENT, words: int = SHINGLE_WORDS, bins: int = BINS, rows: int = ROWS
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, set_key, group, component_id, kept.

    ``group`` is the key of the component (null for empty sets), ``component_id`` the
    least doc_id in it, ``kept`` whether the document is the one that stays.
    """
    signed = materialize(signatures(docs, words, bins, rows))
    nodes = materialize(
        signed.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(
            F.min("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")
        )
    )

    def sets_of(keys: DataFrame) -> DataFrame:
        """Sets of one document for each key, from its text."""
        wanted = keys.join(nodes, "set_key").select(F.col("doc_id").alias("wanted_id")).distinct()
        have = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
        return shingle_sets(have, words).groupBy("set_key").agg(F.first("set").alias("set"))

    labels = group_buckets(nodes.select("set_key", "n", F.explode("bands").alias("bucket")), sets_of, percent)
    named = nodes.join(labels, F.col("set_key") == F.col("node"), "left").select(
        "set_key", F.coalesce("root", "set_key").alias("group"), "doc_id"
    )
    least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = named.drop("doc_id").join(least, "group")
    out = signed.drop("bands").join(named, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.withColumn("component_id", own).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def drop_near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` with one document of each group left; documents without words all stay."""
    found = near_duplicates(docs, percent, words)
    stay = found.where("kept")
    named = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("~"))  # null ids are one name
    # of repeated rows of the id that stays, the first one by its other columns
    first = stay.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(F.struct(named.alias("id"), "text_hash")).alias("row"))
    keep = first.select(F.col("row.id").alias("row_id_"), F.col("row.text_hash").alias("row_hash_")).distinct()
    hashed = docs.withColumn("row_id_", named).withColumn("row_hash_", F.xxhash64("text"))
    words_in = text_or_empty().rlike("[^\\x20\\x09-\\x0D]")
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != "text"]))
    order = Window.partitionBy("row_id_", "row_hash_").orderBy(others)
    one = hashed.where(words_in).join(keep, ["row_id_", "row_hash_"], "left_semi").withColumn("row_at_", F.row_number().over(order))
    return one.where("row_at_ = 1").drop("row_at_").unionByName(hashed.where(~words_in)).select(docs.columns)
