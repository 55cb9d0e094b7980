"""Document fingerprints by SpotSigs.

A spot is a common word (an anchor) that is followed by content words; its
signature is the anchors in a row with the chain of the next ``CHAIN`` content
words.  Anchors are the most frequent words of the corpus itself, in whatever
languages it has (``common_words``), and one word in ``HASHED_ONE_IN`` by a rule
on its hash, so texts of a language that is rare in the corpus have spots all
over too.  The start of the text counts as an anchor, so any text with a letter
has a spot.  A document's fingerprint is its set of hashed signatures,
written as sorted hex numbers; equal texts have equal ones.  Likeness is the
Jaccard similarity of two sets.

Near-duplicates (``similar_groups``) are found without comparing all: sets are
partitioned by length so that a pair at or above the threshold lies in the
same or in neighbouring partitions, each set is entered under its first
signatures only (as many as a similar set cannot miss, in an order that has
signatures of frequent hash buckets last), and a pair is compared in full only
if its lengths allow the threshold.  Entries are grouped by the star turns of
``near_dedup``, never as all pairs.

Everything is DataFrame expressions.

Defined results: a null or empty text, or one without letters or digits, has
no spots and an empty fingerprint; two empty fingerprints are alike to 1, an
empty and another one to 0, and empty ones are grouped with nothing; repeated and null
``doc_id`` rows are documents of their own, null ids first in the order and
rows of one id by a hash of their texts, then by text; a
single document is its own successor; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.llm.common import text_or_empty
from rollscan.llm.near_dedup import group_buckets, small
from rollscan.session import drop_tables, materialize, release_shuffles, table_scope

#: Anchors are so many words at most, and so many of all words of the corpus at most (in percent).
ANCHORS = 200
ANCHOR_PERCENT = 60
#: Longer words are no anchors (common words are short); it keeps the count of rare words out of the shuffle.
ANCHOR_CHARS = 6
#: Words whose hash is 0 modulo this number are anchors as well.
HASHED_ONE_IN = 16
CHAIN = 2
#: Characters of text in a bucket of the order by doc_id, about.
BUCKET_CHARS = 4 << 20
#: Buckets at most; beyond BUCKET_CHARS times so many characters the buckets grow (each is sorted with spilling).
MAX_BUCKETS = 1 << 16
#: Sub-buckets of one id (rows of a repeated or null id), at most.
SUB_BUCKETS = 1 << 20
#: Hash buckets by which the frequency of signatures is told; the counts are a literal of so many numbers.
FREQUENCY_BUCKETS = 1 << 16
#: A partition by length spans this power of the least length ratio; only sets near its lower end also enter the one below.
SPAN = 4
GLUE = "\x01"
LONGS = "array<bigint>"


def plain_words(text: Column) -> Column:
    """Words of letters and digits of a text, lower-cased, as an array; one empty word if there is none."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def common_words(docs: DataFrame, most: int = ANCHORS, percent: int = ANCHOR_PERCENT) -> list[str]:
    """The most frequent words over all documents, at most ``most`` and no more of all words than ``percent``; ties by word."""
    words = docs.select(F.explode(plain_words(text_or_empty())).alias("w")).where("w <> ''")
    short = F.when(F.length("w") <= ANCHOR_CHARS, F.col("w"))  # all others are one row
    counted = materialize(words.groupBy(short.alias("w")).agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    out, seen = [], 0
    for r in counted.where(F.col("w").isNotNull()).orderBy(F.col("n").desc(), "w").limit(most).collect():
        seen += r["n"]
        if 100 * seen > percent * total:
            break
        out.append(r["w"])
    return out


def spots(text: Column, anchors: list[str], chain: int = CHAIN) -> Column:
    """Sorted set of signature hashes of a text (array of distinct longs)."""

    def glued(words: Column) -> Column:
        """The words with every anchor glued to the word after it: "of the house" becomes one unit."""
        common = lambda w: w.isin(anchors) if anchors else F.lit(False)  # noqa: E731  a lookup in a hash set
        anchor = lambda w: common(w) | (F.pmod(F.xxhash64(w), F.lit(HASHED_ONE_IN)) == 0)
        joined = F.array_join(F.transform(words, lambda w: F.concat(w, F.when(anchor(w), F.lit(GLUE)).otherwise(F.lit(" ")))), "")
        # a text may end in anchors: they stand with an empty word
        return F.split(F.concat(F.lit(GLUE), F.regexp_replace(joined, " $", "")), " ")

    def signatures(pair: Column) -> Column:
        unit, bare = pair["unit"], pair["bare"]
        after = lambda i: [F.coalesce(F.get(bare, i + k), F.lit("")) for k in range(1, chain)]
        all_ = F.transform(unit, lambda u, i: F.when(F.contains(u, F.lit(GLUE)), F.xxhash64(u, *after(i))))
        return F.sort_array(F.array_distinct(F.array_compact(all_)))

    def with_bare(u: Column) -> Column:
        bare = F.transform(u, lambda x: F.substring_index(x, GLUE, -1))
        return let(F.struct(u.alias("unit"), bare.alias("bare")), signatures)

    nothing = F.array().cast(LONGS)
    return let(plain_words(text), lambda w: F.when(F.get(w, F.lit(0)) == "", nothing).otherwise(let(glued(w), with_bare)))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(spot_set: Column) -> Column:
    return F.array_join(F.transform(spot_set, lambda h: F.hex(h)), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def fingerprints(docs: DataFrame, anchors: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """One row per document: doc_id, n_spots, spots and fingerprint."""
    anchors = common_words(docs) if anchors is None else anchors
    d = docs.select("doc_id", spots(text_or_empty(), anchors, chain).alias("spots"))
    return d.select("doc_id", F.size("spots").alias("n_spots"), "spots", fingerprint(F.col("spots")).alias("fingerprint"))


def bounds_passed(key: Column, bounds: list[int]) -> Column:
    """Number of sorted bounds at or below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded into one literal
    middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    pair = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))

    def step(s: Column, _: Column) -> Column:
        passed = F.get(table, middle(s)) <= key
        halved = F.when(passed, pair(middle(s) + 1, s["high"])).otherwise(pair(s["low"], middle(s)))
        return F.when(s["low"] < s["high"], halved).otherwise(s)

    rounds = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(rounds, pair(F.lit(0), F.lit(len(bounds))), step, lambda s: s["low"])


def order_buckets(d: DataFrame, bucket_chars: int) -> Column:
    """Number of the bucket of a row (doc_id, text), rising with doc_id, nulls first.

    Ids are cut into buckets of about equal numbers of rows.  Rows of one id
    that would fill several buckets, or of no id, are dealt over sub-buckets by
    a hash of their texts.
    """
    rows, nulls, chars = d.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.sum(F.length("text"))).first()
    n = min(MAX_BUCKETS, max(1, (chars or 0) // bucket_chars))
    cuts = [i / n for i in range(1, n)]
    found = (d.agg(F.percentile_approx("doc_id", cuts, 20 * n)).first()[0] if cuts else []) or []
    bounds = sorted(set(found))
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast(LONGS)  # noqa: E731  folded into one literal
    at = bounds_passed(F.col("doc_id"), bounds)
    hashed = lambda parts: F.pmod(F.xxhash64("text"), parts)
    sub = F.lit(0)
    if bounds:
        parts = F.get(numbers([found.count(b) for b in bounds]), at - 1)  # of the id at the lower bound
        is_bound = F.get(numbers(bounds), at - 1) == F.col("doc_id")
        sub = F.when((at > 0) & (parts > 1), F.when(is_bound, hashed(parts)).otherwise(parts)).otherwise(0)
    of_null = hashed(F.lit(max(1, n * nulls // max(rows, 1)))) - SUB_BUCKETS  # before all others
    return F.when(F.col("doc_id").isNull(), of_null).otherwise(at.cast("long") * SUB_BUCKETS + F.least(sub, F.lit(SUB_BUCKETS - 1))).cast("long")


def with_next(docs: DataFrame, anchors: list[str], bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, text, spots and those of the next document by doc_id (after the last, the first).

    A window orders each bucket of ids.  The first document of a bucket is
    also entered at the end of the bucket before it, so no row needs another
    bucket.  Texts are shuffled once, before their spots are taken.
    """
    d = docs.select("doc_id", text_or_empty().alias("text"))
    d = d.withColumn("bucket", order_buckets(d, bucket_chars))

    # first row of each bucket that has rows, and the bucket before it; as many rows as buckets
    firsts = d.groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("first"))
    order = Window.orderBy("bucket")
    ends = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(
        F.col("bucket").alias("of"), F.col("first.doc_id").alias("first_id"),
        F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(ends)).alias("before"),
    )
    guests = d.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("bucket") == F.col("of")))
    guests = guests.groupBy("before").agg(F.min("text").alias("text")).select(
        F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.col("before").alias("bucket"), F.lit(True).alias("guest")
    )
    rows = d.withColumn("guest", F.lit(False)).unionByName(guests).repartition("bucket")
    rows = rows.withColumn("spots", spots(F.col("text"), anchors))
    place = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(place)).withColumn("next_spots", F.lead("spots").over(place))
    return rows.where(~F.col("guest")).drop("guest", "bucket")


def edited_likeness(docs: DataFrame, anchors: list[str] | None = None) -> DataFrame:
    """Fingerprints of all documents and of their texts with the last quarter replaced by the next one's beginning."""
    anchors = common_words(docs) if anchors is None else anchors
    d = with_next(docs, anchors)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "spots", "next_spots")
    d = d.withColumn("edited_spots", spots(F.col("edited"), anchors))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness("spots", "edited_spots").alias("near_edited"), likeness("spots", "next_spots").alias("near_next"),
        F.size("spots").alias("n_spots"), set_key(F.col("spots")).alias("set_key"),
    )


def set_key(spot_set: Column) -> Column:
    """Digest of 128 bits that names a set of spots, the empty one too."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), spot_set)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def frequent_last(sets: DataFrame) -> Column:
    """The signatures of a set (column spots) in one common order: by the number of entries in their hash bucket, then by value."""
    bucket = lambda h: F.pmod(h, F.lit(FREQUENCY_BUCKETS))
    found = sets.select(F.explode(F.transform("spots", bucket)).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()
    counts = [0] * FREQUENCY_BUCKETS
    for r in found:  # a row per bucket at most
        counts[r["b"]] = r["n"]
    table = F.split(F.lit(",".join(map(str, counts))), ",").cast(LONGS)  # folded into one literal
    ranked = F.transform("spots", lambda h: F.named_struct(F.lit("n"), F.get(table, bucket(h).cast("int")), F.lit("h"), h))
    return F.transform(F.sort_array(ranked), lambda r: r["h"])


def set_groups(spotted: DataFrame, percent: int = 80) -> DataFrame:
    """set_key and group_id, the least doc_id a set reaches, of every set of several documents or alike to another one.

    ``spotted`` has doc_id and spots of every document; it is read once.  The
    result is a written table.
    """
    with table_scope() as written:
        keyed = spotted.select("doc_id", let(F.col("spots"), lambda s: F.struct(set_key(s).alias("key"), s.alias("spots"))).alias("p"))
        one = keyed.groupBy(F.col("p.key").alias("set_key")).agg(
            F.first("p.spots").alias("spots"), F.min("doc_id").alias("least"), F.count("*").alias("copies")
        )
        # the empty set is one row here; a filter before would take the spots of every text once more
        one = materialize(one.withColumn("n", F.size("spots"))).where("n > 0")
        release_shuffles(spotted.sparkSession)
        share = percent / 100
        # a set of n can be alike to one of share * n: that may lie in the partition below
        part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(share**-SPAN)) + 1e-9).cast("int")
        below = F.floor(F.log(F.col("n") * share) / F.log(F.lit(share**-SPAN)) - 1e-9).cast("int")
        # two sets above the threshold share one of their first signatures in any common order
        first = F.slice(frequent_last(one), F.lit(1), F.col("n") - F.ceil(F.col("n") * share - 1e-9).cast("int") + 1)
        entered = one.select("set_key", "n", F.explode(F.array_distinct(F.array(part, below))).alias("part"), first.alias("first"))
        entered = entered.select("set_key", "n", "part", F.explode("first").alias("spot"))
        buckets = entered.select(F.xxhash64("part", "spot").alias("bucket"), "set_key", F.col("n").cast("long").alias("n"))
        sets = lambda keys: one.join(keys, "set_key", "left_semi").select("set_key", F.col("spots").alias("set"))
        labels = group_buckets(buckets, sets, percent)
        named = one.select("set_key", "least", "copies").join(labels, F.col("set_key") == F.col("node"), "left")
        named = named.where((F.col("copies") > 1) | F.col("root").isNotNull())
        named = materialize(named.select("set_key", F.coalesce("root", "set_key").alias("group"), "least"))
        ids = named.groupBy("group").agg(F.min("least").alias("group_id"))
        groups = materialize(named.select("set_key", "group").join(ids, "group").select("set_key", "group_id"))
    drop_tables(spotted.sparkSession, written[:-1])
    release_shuffles(spotted.sparkSession)
    return groups


def with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (doc_id, n_spots, set_key, ...) with group_id in place of set_key; the own doc_id where no group is named."""
    others = [c for c in rows.columns if c != "set_key"]
    # rows without spots are dealt over keys that no group has
    key = F.when(F.col("n_spots") > 0, F.col("set_key")).otherwise(F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    named = rows.withColumn("set_key", key).join(small(groups), "set_key", "left")
    return named.select(*others, F.coalesce(F.when(F.col("n_spots") > 0, F.col("group_id")), F.col("doc_id")).alias("group_id"))


def similar_groups(docs: DataFrame, percent: int = 80, chain: int = CHAIN) -> DataFrame:
    """One row per document: doc_id and group_id, the least doc_id it reaches by likeness of at least ``percent``.

    Documents with equal fingerprints are one entry; documents without spots
    stay alone.
    """
    spotted = materialize(docs.select("doc_id", spots(text_or_empty(), common_words(docs), chain).alias("spots")))
    rows = spotted.select("doc_id", F.size("spots").alias("n_spots"), set_key(F.col("spots")).alias("set_key"))
    return with_group(rows, set_groups(spotted, percent)).select("doc_id", "group_id")


def grouped_likeness(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``edited_likeness`` with group_id, as ``similar_groups`` finds it among all documents."""
    anchors = common_words(docs)
    groups = set_groups(docs.select("doc_id", spots(text_or_empty(), anchors).alias("spots")), percent)
    return with_group(edited_likeness(docs, anchors), groups)
