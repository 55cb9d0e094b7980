"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Every document gets plain counts (words, symbols, repeated lines, words in
repeated five-word windows) and a score: the mean, over its hashed uni- and
bigrams, of ``log p_target(bucket) - log p_raw(bucket)``.  The raw multinomial
is counted over the whole corpus, the target one over the trusted documents
among it (labelled good and not toxic); both have ``BUCKETS`` cells and,
scaled to the same total, a prior count of ``PRIOR`` in each.  A document is kept if it passes the base rule and its
score reaches ``MIN_SCORE``: a fixed threshold, so every document gets the
same verdict on every run over the same corpus (the weights are counts of it).

Everything is DataFrame expressions.  The weights are one array of
``BUCKETS`` doubles, handed to the scoring scan as a scalar subquery, so
scoring needs no shuffle.  The trusted ids that are broadcast are at most
about ``TRUSTED_MAX`` (a hash sample of the labelled rows beyond that).

Defined results: null text has no words and fails the base rule; a text
without n-grams scores 0; without trusted documents all scores are 0; rows
with null or repeated ``doc_id`` are scored like any other row (null ids are
never trusted; an id with contradicting labels is not trusted); other input
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscan.llm.common import text_or_empty, words_of

BUCKETS = 65_536
TRUSTED_MAX = 50_000
MIN_SCORE = -0.1
#: Prior count of every bucket; it keeps rare n-grams, seen once or twice, from deciding.
PRIOR = 8
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
HASH_SPACE = 1 << 31


def tokens(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, text, words and their 64-bit hashes, with the columns to carry along."""
    d = docs.select("doc_id", text_or_empty().alias("text"), *carry)
    d = d.withColumn("words", words_of(F.col("text")))
    return d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body and its lambdas name it.

    A plain column would be copied into every place that names it when the
    optimiser pushes a filter through the projection.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def buckets(hashes: str, n: int = BUCKETS) -> Column:
    """Bucket numbers of the unigrams, then of the bigrams."""

    def of(h: Column) -> Column:
        uni = F.transform(h, lambda x: F.pmod(x, F.lit(n)).cast("int"))
        firsts = F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))
        return F.concat(uni, F.transform(firsts, lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(n)).cast("int")))

    return let(F.col(hashes), of)


def trusted_ids(labels: DataFrame, most: int = TRUSTED_MAX) -> DataFrame:
    """Ids labelled good and never bad or toxic; beyond ``most`` of them a hash sample of about that size."""
    by_id = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("worst"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    good = by_id.where((F.col("worst") == 1) & (F.col("toxic") == 0)).select("doc_id")
    share = F.lit(most * HASH_SPACE) / F.greatest(good.agg(F.count("*")).scalar(), F.lit(1))
    return good.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASH_SPACE)) < share)


def gram_weights(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS) -> DataFrame:
    """One row with ``weights``: log p_target - log p_raw of each of the n buckets."""
    mark = F.broadcast(trusted.select(F.col("doc_id").alias("trusted_id")))
    d = tokens(docs).join(mark, F.col("doc_id") == F.col("trusted_id"), "left")
    grams = d.select(F.explode(buckets("hashes", n)).alias("bucket"), F.col("trusted_id").isNotNull().cast("long").alias("t"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    # every bucket, also the empty ones; n rows in all
    cells = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("cell"))
    cells = cells.join(counted, F.col("cell") == F.col("bucket"), "left").select(
        F.struct("cell", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")).alias("c")
    )
    one = cells.agg(
        F.sort_array(F.collect_list("c")).alias("cells"), F.sum("c.raw").alias("raw_all"), F.sum("c.target").alias("target_all")
    )
    # raw counts scaled to the target's size: both multinomials get the same prior and the same total
    expected = lambda c: c["raw"] * (F.col("target_all") / F.col("raw_all"))
    weight = lambda c: F.when(F.col("target_all") == 0, F.lit(0.0)).otherwise(
        F.log((c["target"] + PRIOR) / (expected(c) + PRIOR))
    )
    return one.select(F.transform("cells", weight).alias("weights"))


def windows(h: Column) -> Column:
    """Hashes of all windows of WINDOW words."""
    firsts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
    return F.transform(firsts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))


def repeat_words(hashes: Column) -> Column:
    """Words in windows whose hash occurs at least twice."""

    def starts(s: Column) -> Column:  # s: (hash, position), sorted; equal hashes are neighbours
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(at: Column) -> Column:  # each start covers up to the next one, WINDOW words at most
        step = lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)))
        return F.aggregate(F.transform(at, step), F.lit(0), lambda a, b: a + b).cast("long")

    def count(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # the costly part is for texts that have a repeated window at all
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(let(ordered, starts), covered)).otherwise(F.lit(0).cast("long"))

    return let(hashes, count)


def base_counts(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """tokens() with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    d = tokens(docs, carry)
    n = F.size("words")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.withColumn("lines", lines)
    return d.select(
        "doc_id",
        *carry,
        "hashes",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(F.col("hashes"), lambda h: repeat_words(windows(h))).alias("n_repeat_words"),
    ).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )


def verdicts(counted: DataFrame, weights: Column, min_score: float, n: int) -> DataFrame:
    """base_counts() with score and kept."""
    d = counted.withColumn("grams", buckets("hashes", n)).withColumn("weights", weights)
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get("weights", b))
    d = d.withColumn("score", total / F.greatest(F.size("grams"), F.lit(1))).drop("grams", "hashes", "weights")
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score))


def quality_verdicts(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE, n: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, score (mean log-likelihood ratio) and kept."""
    weights = gram_weights(docs, trusted_ids(labels), n).scalar()
    return verdicts(base_counts(docs), weights, min_score, n)


def keep_good(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE, n: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    weights = gram_weights(docs, trusted_ids(labels), n).scalar()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = verdicts(base_counts(docs.select("doc_id", "text", row.alias("row_")), carry=["row_"]), weights, min_score, n)
    # the partition number keeps the filter above the verdict, which is so computed once
    return judged.withColumn("part_", F.spark_partition_id()).where("kept and part_ >= 0").select("row_.*")
