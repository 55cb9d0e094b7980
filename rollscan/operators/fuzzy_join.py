"""Fuzzy theta join of record names against searched names.

A pair matches when both raw strings are non-empty and the token-set
similarity of their normalised forms reaches the threshold.  The join never
forms the cross product (except at threshold 0, where every pair matches by
definition).  Candidates come from one equi-join on an exploded key column
whose keys are lossless for the threshold:

* ``L`` keys (length): the query side is exploded by every name length that
  can still reach ``t`` (LCS <= min length); the join condition adds native
  lower bounds on the Indel distance: a popcount over the character and bigram
  counts of both strings (``sketch_within``), then ``levenshtein(a, b, budget)``.
* ``P`` keys (length, bigram occurrence), shuffle strategy only: where ``t``
  forces ``m >= 1`` common bigram occurrences (common bigrams >= 3·LCS − L − 1),
  both sides keep only the prefix of ``n − m + 1`` elements in one global
  order (rarest first; prefix filtering), so frequent bigrams mostly drop
  out; the row of the *smallest* shared prefix element is kept, so a pair is
  produced once without a de-duplicating shuffle.
* ``T`` keys (token): names or queries with several tokens (inner non-space
  whitespace) also meet every partner that shares a token (the token-set
  score is 100 there or not bounded by length); again only the smallest
  shared token's row is kept, and pairs that the ``L``/``P`` keys already
  give are left out.

Batch form (``dedupe=True``): names and queries are first reduced to
distinct normalised strings (partial aggregation before the shuffle, so
repeated names cost little) and the names are spread over one partition per
core; the matching pair table is then joined back to all records and all
queries (AQE broadcasts it when its measured size allows and splits skewed
names otherwise).  Strategies differ in how the query side meets the names:

* ``broadcast`` (query side checked small by one aggregate): ``L`` and ``T``
  keys, the exploded query keys are broadcast, names probe them map-side;
* where ``t`` can't force common bigrams (up to 66), whatever the strategy, the
  pairs of a length meet in blocks of bounded size on both sides and a task
  scores each query's whole block at once (``block_pairs``); ``T`` keys give
  the pairs with a common token;
* ``shuffle`` (beyond the check): ``L``, ``P`` and ``T`` keys, both sides
  shuffled on the key.  The rows of every key are counted on both sides first;
  a key that is much of the work is split: the side with more rows is dealt
  over its salts, the other one repeated under each (``balanced``).

Stream form (``dedupe=False``): records probe the broadcast query keys
directly, one pass, no state (a stream-static join).

Survivors are verified exactly by the token-set score, a native expression
over the bit-parallel LCS (for single tokens this is the Indel ratio
``200·LCS/L``).  Blocks need no verification: their LCS is exact.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollscan.functions.similarity import (
    indel_budget,
    lcs_by_masks,
    lcs_masks,
    lcs_of_block,
    length_window,
    levenshtein_within,
    sketch,
    sketch_within,
    token_set_ratio,
)
from rollscan.functions.text import MAX_FIELD_CHARS, has_inner_whitespace, normalize_bn, py_split
from rollscan.params import SearchParams
from rollscan.session import materialize, ship_package

# Below this threshold the length window of a query grows past the longest
# name, so it is capped at the longest name present (one small aggregate).
_MIN_EXPLODE_THRESHOLD = 10
# Bigram prefixes can only be forced (m >= 1) above this threshold.
_MAX_UNFORCED_THRESHOLD = 66

# Matching (name, query) pair tables up to this many rows are broadcast to the
# records (counted after they are written once); larger ones shuffle.
BROADCAST_MAX_PAIRS = 1_000_000
# The pairs of a key are split until none has more than this share of the pairs of a shuffle partition.
SPLIT_SHARE = 16
BROADCAST_MAX_PAIR_BYTES = 64 * 1024 * 1024
# Names of one length, and queries, that meet in a block at most, about.
BLOCK_NAMES = 8192
BLOCK_QUERIES = 1024

_KEY = "struct<kind:string,len:int,tok:string,cnt:bigint,occ:int>"
_ELEM = "struct<cnt:bigint,g:string,k:int>"


def _with_forms(df: DataFrame, raw: str, p: str) -> DataFrame:
    """Add normalised form ``p``, token-set form, multi-token flag, length, tokens."""
    kept = df.where(F.col(raw) != "")  # null != '' is null: dropped too
    return _forms_of_normalised(kept.select("*", normalize_bn(raw).alias(p)), p)


def _key(kind: str, length: Column, tok: Column, cnt: Column | None = None, occ: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        length.cast("int").alias("len"),
        tok.alias("tok"),
        (cnt if cnt is not None else F.lit(0)).cast("bigint").alias("cnt"),
        (occ if occ is not None else F.lit(0)).cast("int").alias("occ"),
    )


def _elem_key(length: Column, e: Column) -> Column:
    return _key("P", length, e["g"], e["cnt"], e["k"])


def _indexed_bigrams(df: DataFrame, p: str) -> DataFrame:
    """Bigram occurrences ``(g, k)`` of each string: the k-th occurrence of bigram g (a
    multiset as a set); a string shorter than a bigram keeps one row with null ``g``.

    Bigrams are counted per string and the counts numbered, so the work is
    linear in the length of the strings.
    """
    c = F.col(p + "_k")
    starts = F.when(F.length(c) >= 2, F.sequence(F.lit(1), F.length(c) - 1))
    grams = df.select(p, F.explode_outer(F.transform(starts, lambda i: F.substring(c, i, F.lit(2)))).alias("g"))
    counted = grams.groupBy(p, "g").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.select(p, "g", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))


def _required_common(total: Column, t: int) -> Column:
    """Least number of common bigram occurrences of a pair of total length L reaching t:
    3·ceil(t·L/200) − L − 1 (it forces a shared bigram when >= 1)."""
    min_lcs = F.floor((F.lit(int(t)) * total + F.lit(199)) / F.lit(200))
    return (F.lit(3) * min_lcs - total - F.lit(1)).cast("int")


def _sorted_elements(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``_a_s`` / ``_b_s``: each string's bigram occurrences in one global order
    (how many strings hold the occurrence, then bigram, then occurrence number),
    so prefixes hold the rarest elements and frequent bigrams drop out of them.

    The frequency table has one row per distinct bigram occurrence; AQE
    broadcasts it to the element rows when its measured size allows.  The
    string forms are functions of the string, so they are recomputed after
    the regrouping instead of joined back.
    """
    ea, eb = _indexed_bigrams(a, "_a"), _indexed_bigrams(b, "_b")
    held = ea.select("g", "k").unionByName(eb.select("g", "k")).where(F.col("g").isNotNull())
    freq = held.groupBy("g", "k").agg(F.count(F.lit(1)).alias("cnt"))

    def attach(df: DataFrame, p: str) -> DataFrame:
        rows = (ea if p == "_a" else eb).join(freq, ["g", "k"], "left")
        elem = F.when(F.col("g").isNotNull(), F.struct("cnt", "g", "k"))
        grouped = rows.groupBy(p).agg(
            F.array_sort(F.collect_list(elem)).cast(f"array<{_ELEM}>").alias(p + "_s")
        )
        return _forms_of_normalised(grouped, p)

    return attach(a, "_a"), attach(b, "_b")


@functools.lru_cache(maxsize=128)
def _token_keys(p: str) -> Column:
    return F.transform(F.col(p + "_t"), lambda tok: _key("T", F.lit(0), tok))


@functools.lru_cache(maxsize=128)
def _a_prefix(t: int) -> Column:
    """Prefix of ``_a_s`` long enough for every forced partner length:
    ``n − m + 1`` elements for the smallest positive required overlap m."""
    lo, hi = length_window(F.col("_a_l"), t)
    ms = F.transform(F.sequence(lo, hi), lambda lb: _required_common(F.col("_a_l") + lb, t))
    m = F.array_min(F.filter(ms, lambda x: x >= 1))
    n = F.size(F.col("_a_s"))
    return F.when(m.isNull() | (F.col("_a_l") <= 0), F.array().cast(f"array<{_ELEM}>")).otherwise(
        F.slice(F.col("_a_s"), 1, F.greatest(n - m + 1, F.lit(0)))
    )


@functools.lru_cache(maxsize=128)
def _a_keys(use_bigrams: bool) -> Column:
    length_key = F.when(
        F.col("_a_l") > 0, F.array(_key("L", F.col("_a_l"), F.lit("")))
    ).otherwise(F.array().cast(f"array<{_KEY}>"))
    keys = F.concat(length_key, _token_keys("_a"))
    if use_bigrams:
        keys = F.concat(keys, F.transform(F.col("_a_pre"), lambda e: _elem_key(F.col("_a_l"), e)))
    return F.transform(keys, lambda k: F.struct(k.alias("_ka")))


@functools.lru_cache(maxsize=128)
def _b_keys(t: int, use_bigrams: bool, max_len: int | None = None) -> Column:
    """Keys of a query: per name length that can reach t, either its prefix
    elements (when t forces common bigrams) or the bare length; plus tokens.
    Each key carries ``pl``, the prefix length used for it.  ``max_len`` caps
    the lengths at the longest name present."""
    lo, hi = length_window(F.col("_b_l"), t)
    if max_len is not None:
        hi = F.least(hi, F.lit(int(max_len)))
    lengths = F.when((F.col("_b_l") > 0) & (lo <= hi), F.sequence(lo, hi)).otherwise(
        F.array().cast("array<int>")
    )

    def plain(k: Column) -> Column:
        return F.struct(k.alias("_kb"), F.lit(0).alias("_b_pl"))

    def bare(n: Column) -> Column:
        return F.array(plain(_key("L", n, F.lit(""))))

    if not use_bigrams:
        length_keys = F.flatten(F.transform(lengths, bare))
    else:
        n_b = F.size(F.col("_b_s"))

        def per_length(n: Column) -> Column:
            m = _required_common(n + F.col("_b_l"), t)
            pl = F.greatest(n_b - m + 1, F.lit(0))
            pre = F.slice(F.col("_b_s"), 1, pl)
            return F.when(
                m >= 1, F.transform(pre, lambda e: F.struct(_elem_key(n, e).alias("_kb"), pl.alias("_b_pl")))
            ).otherwise(bare(n))

        length_keys = F.flatten(F.transform(lengths, per_length))
    return F.concat(length_keys, F.transform(_token_keys("_b"), plain))


@functools.lru_cache(maxsize=128)
def _bound(t: int) -> Column:
    """Native, lossless pre-filter on the token-set forms: length window + lower bounds of the distance."""
    lo, hi = length_window(F.col("_b_l"), t)
    return (
        (F.col("_a_l") > 0)
        & (F.col("_b_l") > 0)
        & (F.col("_a_l") >= lo)
        & (F.col("_a_l") <= hi)
        & _near_enough(t)
    )


@functools.lru_cache(maxsize=128)
def _near_enough(t: int) -> Column:
    """Neither the sketches nor the Levenshtein distance of the token-set forms rule the pair out."""
    budget = indel_budget(F.col("_a_l"), F.col("_b_l"), t)
    return sketch_within(F.col("_a_c"), F.col("_b_c"), budget) & levenshtein_within(F.col("_a_k"), F.col("_b_k"), budget)


@functools.lru_cache(maxsize=128)
def _join_condition(t: int) -> Column:
    kind, tok = F.col("_ka.kind"), F.col("_ka.tok")
    same_key = F.col("_ka") == F.col("_kb")
    first_tok = F.array_min(F.array_intersect(F.col("_a_t"), F.col("_b_t")))
    cond = ((kind == "L") & _near_enough(t)) | (
        (kind == "T") & (F.col("_a_m") | F.col("_b_m")) & ~_bound(t) & (tok == first_tok)
    )
    return same_key & cond


@functools.lru_cache(maxsize=128)
def _prefix_condition(t: int) -> Column:
    """P keys: the pair is kept only under its smallest shared prefix element."""
    elem = F.struct(F.col("_ka.cnt").alias("cnt"), F.col("_ka.tok").alias("g"), F.col("_ka.occ").alias("k"))
    first = F.array_min(F.array_intersect(F.col("_a_pre"), F.slice(F.col("_b_s"), 1, F.col("_b_pl"))))
    return (F.col("_ka.kind") == "P") & (F.col("_ka") == F.col("_kb")) & _near_enough(t) & (elem == first)


def _candidates(a: DataFrame, b: DataFrame, t: int, broadcast_b: bool, max_len: int | None = None) -> DataFrame:
    """Candidate pairs of ``a`` (``_a`` forms) and ``b`` (``_b`` forms), each pair once.

    Always an equi-join on the exploded keys (hash join), never a nested loop.
    """
    use_bigrams = (not broadcast_b) and t > _MAX_UNFORCED_THRESHOLD
    if use_bigrams:
        a, b = _sorted_elements(a, b)
        a = a.withColumn("_a_pre", _a_prefix(t))
    ak = a.select("*", F.inline(_a_keys(use_bigrams)))
    bk = b.select("*", F.inline(_b_keys(t, use_bigrams, max_len)))
    cond = _join_condition(t)
    if use_bigrams:
        cond = cond | _prefix_condition(t)
    if broadcast_b:
        bk = F.broadcast(bk)
    else:
        ak, bk = balanced(ak, bk)
        cond = cond & (F.col("_a_salt") == F.col("_b_salt"))
    drop = [c for c in ("_ka", "_kb", "_b_pl", "_a_s", "_b_s", "_a_pre", "_a_salt", "_b_salt") if c in ak.columns + bk.columns]
    return ak.join(bk, cond, "inner").drop(*drop)


def balanced(ak: DataFrame, bk: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt (``_a_salt``, ``_b_salt``), by the measured pairs of their key.

    A key's pairs are the product of its rows on both sides.  Keys that hold
    more than a ``SPLIT_SHARE``-th of a shuffle partition's share of all pairs
    are split into as many salts as bring them below: of the side with more
    rows each row goes to one salt by its hash, those of the other side to all.
    There are at most SPLIT_SHARE times the shuffle partitions of such keys,
    so they are broadcast.
    """
    parts = parts or int(ak.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    na = ak.groupBy(F.col("_ka").alias("_k")).agg(F.count(F.lit(1)).alias("na"))
    nb = bk.groupBy(F.col("_kb").alias("_k")).agg(F.count(F.lit(1)).alias("nb"))
    work = materialize(na.join(nb, "_k").withColumn("pairs", F.col("na").cast("double") * F.col("nb")))
    total = work.agg(F.sum("pairs")).first()[0] or 0.0
    most = max(1.0, total / (parts * SPLIT_SHARE))
    larger = F.greatest("na", "nb").cast("double")
    salts = F.least(F.ceil(F.col("pairs") / most).cast("double"), larger).cast("int")
    heavy = work.where(F.col("pairs") > most).select("_k", salts.alias("_salts"), (F.col("na") >= F.col("nb")).alias("_split_a"))
    heavy = F.broadcast(materialize(heavy))

    def salted(rows: DataFrame, p: str, split: Column) -> DataFrame:
        keyed = rows.join(heavy, F.col("_k" + p[1]) == F.col("_k"), "left")
        one = F.array(F.pmod(F.xxhash64(p), F.col("_salts")).cast("int"))
        every = F.sequence(F.lit(0), F.col("_salts") - 1)
        salt = F.when(F.col("_salts").isNull(), F.array(F.lit(0))).when(split, one).otherwise(every)
        return keyed.withColumn(p + "_salt", F.explode(salt)).drop("_k", "_salts", "_split_a")

    return salted(ak, "_a", F.col("_split_a")), salted(bk, "_b", ~F.col("_split_a"))


def _longest(records: DataFrame, name_col: str, t: int) -> int | None:
    """Longest normalised name (>= its token-set form), needed only for low thresholds."""
    if t >= _MIN_EXPLODE_THRESHOLD:
        return None
    return int(records.agg(F.coalesce(F.max(F.length(normalize_bn(name_col))), F.lit(0))).first()[0])


def _verify(cand: DataFrame, t: int) -> DataFrame:
    """Exact scores; of single tokens from the query's masks, which are made once per query."""
    total = F.col("_a_l") + F.col("_b_l")
    single = ~F.col("_a_m") & ~F.col("_b_m") & (F.col("_a_l") > 0) & F.col("_b_mk").isNotNull()
    ratio = F.lit(100.0) - F.lit(100) * (total - F.lit(2) * lcs_by_masks(F.col("_b_mk"), F.col("_b_l"), F.col("_a_k"))) / total
    score = F.when(single, ratio).otherwise(token_set_ratio(F.col("_a"), F.col("_b")))
    return cand.withColumn("score", score).where(F.col("score") >= F.lit(float(t)))


def choose_strategy(
    queries: DataFrame,
    params: SearchParams,
    query_col: str = "query",
    max_len: int | None = None,
) -> str:
    """Broadcast only behind a size check: one small aggregate over the query side.

    The check bounds what is actually broadcast: the query rows exploded by
    every name length that can reach the threshold (capped at ``max_len``,
    the longest name, when given), estimated at two bytes per character plus
    a fixed row overhead.
    """
    if params.strategy != "auto":
        return params.strategy
    t = int(params.threshold)
    lq = F.length(normalize_bn(query_col))
    if t > 0:
        lo, hi = length_window(lq, t)
        if max_len is not None:
            hi = F.least(hi, F.lit(int(max_len)))
        rows = F.greatest(hi - lo + 1, F.lit(0)) + F.lit(1)
    else:
        rows = F.lit(1)
    row = queries.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length(query_col)), F.lit(0)).alias("c"),
        F.coalesce(F.sum(rows.cast("long") * (lq * 4 + 64)), F.lit(0)).alias("b"),
    ).first()
    n, chars, est = int(row["n"]), int(row["c"]), int(row["b"])
    if n <= params.broadcast_max_queries and chars <= params.broadcast_max_chars and est <= params.broadcast_max_bytes:
        return "broadcast"
    return "shuffle"


def _rename_collisions(queries: DataFrame, record_cols: list[str], query_col: str) -> DataFrame:
    """Query-side columns that also exist on the record side get a ``query_`` prefix."""
    for c in queries.columns:
        if c in record_cols and c != query_col:
            queries = queries.withColumnRenamed(c, f"query_{c}")
    return queries


def _drop_work(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_a") or c.startswith("_b")])


def _spread(df: DataFrame) -> DataFrame:
    """Deal the (CPU-heavy) distinct strings over the shuffle partitions.

    AQE coalesces small shuffle outputs into very few partitions by byte
    size; candidate scoring costs CPU per row, not per byte, so the distinct
    names (after a map-side combine, so a frequent name is one row per task)
    are spread again over as many partitions as shuffles are set to have.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _small_enough(pairs: DataFrame) -> bool:
    """Size check of the pair table by rows and by bytes of its strings."""
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_a") + F.octet_length("_b") + 64), F.lit(0)).alias("b")
    ).first()
    return row["n"] <= BROADCAST_MAX_PAIRS and row["b"] <= BROADCAST_MAX_PAIR_BYTES


def count_candidates(names: DataFrame, queries: DataFrame, threshold: int, name_col: str = "name", query_col: str = "query") -> tuple[int, int, int]:
    """Distinct names, distinct queries, and pairs of them that reach the scorer in the shuffled join."""
    a = names.where(F.col(name_col) != "").select(normalize_bn(name_col).alias("_a")).distinct()
    b = queries.where(F.col(query_col) != "").select(normalize_bn(query_col).alias("_b")).distinct()
    cand = _candidates(_forms_of_normalised(a, "_a"), _forms_of_normalised(b, "_b"), int(threshold), broadcast_b=False)
    return a.count(), b.count(), cand.select("_a").count()


def match_pairs(
    names: DataFrame,
    queries: DataFrame,
    threshold: int,
    strategy: str = "broadcast",
    name_col: str = "name",
    query_col: str = "query",
    max_len: int | None = None,
) -> DataFrame:
    """Distinct matching (normalised name ``_a``, normalised query ``_b``, ``score``) pairs.

    Both sides are first reduced to distinct normalised strings (partial
    aggregation before the shuffle, so repeated names cost little).
    """
    t = int(threshold)
    a = names.where(F.col(name_col) != "").select(normalize_bn(name_col).alias("_a")).distinct()
    b = queries.where(F.col(query_col) != "").select(normalize_bn(query_col).alias("_b")).distinct()
    a = _forms_of_normalised(_spread(a), "_a")
    b = _forms_of_normalised(b, "_b")
    broadcast_b = strategy == "broadcast"
    if t <= 0:
        bb = F.broadcast(b) if broadcast_b else b
        return a.crossJoin(bb).select("_a", "_b", F.lit(None).cast("double").alias("score"))
    if max_len is None:
        max_len = _longest(names, name_col, t)
    cand = _candidates(a, b, t, broadcast_b=broadcast_b, max_len=max_len)
    return _verify(cand, t).select("_a", "_b", "score")


def _length_pairs(na: pa.Table, nb: pa.Table, t: int) -> pa.Table:
    """Pairs of a block that reach t by the LCS of their token-set forms, but those with a common token
    among several, whose score is another one."""
    one, many = (na, nb) if len(na) <= len(nb) else (nb, na)
    forms = lambda x: x.column("_a_k" if x is na else "_b_k").to_pylist()
    strings, block = forms(one), forms(many)
    n, lengths = np.array([len(k) for k in strings], np.int64), np.array([len(k) for k in block], np.int64)
    # characters of the block's strings that may be outside the LCS, by the length of the other string
    most = {m: (lengths - (t * (lengths + m) + 199) // 200).astype(np.int32) for m in set(n.tolist())}
    at, other, outside = [], [], []
    for i, left in lcs_of_block(strings, block):
        hit = np.flatnonzero(left <= most[len(strings[i])])
        if len(hit):
            at.append(np.full(len(hit), i))
            other.append(hit)
            outside.append(left[hit])
    i1, i2, out = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (at, other, outside)]
    total = n[i1] + lengths[i2]
    score = 100.0 - 100 * (total - 2 * (lengths[i2] - out)) / total
    ia, ib = (i1, i2) if one is na else (i2, i1)
    ma, mb = (x.column(c).to_numpy() for x, c in ((na, "_a_m"), (nb, "_b_m")))
    several = np.flatnonzero(ma[ia] | mb[ib])
    if len(several):
        ta, tb = ([set(s.split(" ")) for s in x.column(c).to_pylist()] for x, c in ((na, "_a_k"), (nb, "_b_k")))
        keep = np.ones(len(ia), bool)
        keep[several] = [ta[i].isdisjoint(tb[j]) for i, j in zip(ia[several].tolist(), ib[several].tolist())]
        ia, ib, score = ia[keep], ib[keep], score[keep]
    return pa.table({"_a": na.column("_a").take(pa.array(ia)), "_b": nb.column("_b").take(pa.array(ib)), "score": score})


def block_pairs(
    names: DataFrame, queries: DataFrame, threshold: int, name_col: str = "name", query_col: str = "query", max_len: int | None = None
) -> DataFrame:
    """The pairs of ``match_pairs`` at thresholds that force no common bigram.

    Names of one length and the queries that can reach it form a grid of
    blocks, by the counted rows of the length on both sides; a block is one
    group of the shuffle, so no task holds more than a block.
    """
    t = int(threshold)
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = names.where(F.col(name_col) != "").select(normalize_bn(name_col).alias("_a")).distinct()
    b = queries.where(F.col(query_col) != "").select(normalize_bn(query_col).alias("_b")).distinct()
    af = materialize(_forms_of_normalised(_spread(a), "_a").drop("_a_c"))
    bf = materialize(_forms_of_normalised(b, "_b").drop("_b_c"))
    lo, hi = length_window(F.col("_b_l"), t)
    if max_len is not None:
        hi = F.least(hi, F.lit(int(max_len)))
    held = af.where("_a_l > 0").select("_a", "_a_k", "_a_m", F.col("_a_l").alias("_len"))
    asked = bf.where((F.col("_b_l") > 0) & (lo <= hi)).select("_b", "_b_k", "_b_m", F.explode(F.sequence(lo, hi)).alias("_len"))
    blocks = lambda rows, n, size: rows.groupBy("_len").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(n))
    grid = F.broadcast(materialize(blocks(held, "_na", BLOCK_NAMES).join(blocks(asked, "_nb", BLOCK_QUERIES), "_len")))
    own = lambda p, n: F.pmod(F.xxhash64(p), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["_len", "_pa", "_pb"]
    # by number, so that small outputs are not put together into a few long tasks
    held = held.join(grid, "_len").select("_a", "_a_k", "_a_m", "_len", own("_a", "_na").alias("_pa"), every("_nb").alias("_pb")).repartition(parts, *cell)
    asked = asked.join(grid, "_len").select("_b", "_b_k", "_b_m", "_len", every("_na").alias("_pa"), own("_b", "_nb").alias("_pb")).repartition(parts, *cell)

    def score(na: pa.Table, nb: pa.Table) -> pa.Table:
        return _length_pairs(na, nb, t)

    near = held.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(score, "_a string, _b string, score double")
    for x, y, rare in ((af.where("_a_m"), bf, 0), (af.where("not _a_m"), bf.where("_b_m"), 1)):
        if not (x, y)[rare].isEmpty():
            near = near.unionByName(_token_pairs(x, y, t))
    return near


def _token_pairs(a: DataFrame, b: DataFrame, t: int) -> DataFrame:
    """Matching pairs with a common token; each pair under its smallest one."""
    ak, bk = balanced(a.select("*", F.inline(_token_rows("_a"))), b.select("*", F.inline(_token_rows("_b"))))
    first = F.array_min(F.array_intersect(F.col("_a_t"), F.col("_b_t")))
    meet = (F.col("_ka") == F.col("_kb")) & (F.col("_a_salt") == F.col("_b_salt"))
    cand = ak.join(bk, meet & (F.col("_ka.tok") == first))
    return _verify(cand, t).select("_a", "_b", "score")


@functools.lru_cache(maxsize=16)
def _token_rows(p: str) -> Column:
    return F.transform(_token_keys(p), lambda k: F.struct(k.alias("_k" + p[1])))


@functools.lru_cache(maxsize=16)
def _form_columns(p: str) -> tuple[Column, ...]:
    toks = F.array_distinct(py_split(p))
    key = F.array_join(F.array_sort(toks), " ")
    return (
        toks.alias(p + "_t"),
        key.alias(p + "_k"),
        has_inner_whitespace(p).alias(p + "_m"),
        F.length(key).alias(p + "_l"),
        sketch(key).alias(p + "_c"),
        *([lcs_masks(key).alias(p + "_mk")] if p == "_b" else []),
    )


def _forms_of_normalised(df: DataFrame, p: str) -> DataFrame:
    """Token-set form, multi-token flag, length and tokens of an already normalised column ``p``
    (one projection)."""
    return df.select("*", *_form_columns(p))


def fuzzy_join(
    records: DataFrame,
    queries: DataFrame,
    params: SearchParams | None = None,
    name_col: str = "name",
    query_col: str = "query",
    dedupe: bool = True,
) -> DataFrame:
    """One row per (record, query) whose names match; all columns of both sides + ``score``.

    Duplicate queries give duplicate rows; ``score`` is the token-set
    similarity (null at threshold 0, where it is not computed).

    ``dedupe=True`` (batch default): score distinct normalised names only,
    write the pair table once, and join it back to all records (broadcast
    when its row count is small, else a shuffle join where AQE splits skewed
    names) and to the queries.  ``dedupe=False`` (streams): records probe the broadcast
    query keys directly, one pass, no state.
    """
    params = params or SearchParams()
    t = int(params.threshold)
    ship_package(records.sparkSession)
    queries = _rename_collisions(queries, records.columns, query_col)
    # Longest name, only needed below threshold 10: measured in batches; in the
    # stream form the extractor's field cap bounds it.
    if t < _MIN_EXPLODE_THRESHOLD:
        max_len = _longest(records, name_col, t) if dedupe else MAX_FIELD_CHARS
    else:
        max_len = None
    strategy = choose_strategy(queries, params, query_col, max_len)
    if not dedupe:
        if strategy != "broadcast":
            raise ValueError("the single-pass join needs a broadcastable query side")
        a = _with_forms(records, name_col, "_a")
        b = _with_forms(queries, query_col, "_b")
        if t <= 0:
            out = a.crossJoin(F.broadcast(b)).withColumn("score", F.lit(None).cast("double"))
        else:
            out = _verify(_candidates(a, b, t, broadcast_b=True, max_len=max_len), t)
        return _drop_work(out)
    if 0 < t <= _MAX_UNFORCED_THRESHOLD:
        pairs = block_pairs(records, queries, t, name_col, query_col, max_len)
    else:
        pairs = match_pairs(records, queries, t, strategy, name_col, query_col, max_len)
    # The pair table is written once (it ends the CPU-heavy part) and counted:
    # broadcast to the records when small, so records never shuffle; otherwise
    # a shuffle join, where AQE splits skewed names.
    pairs = materialize(pairs)
    if _small_enough(pairs):
        pairs = F.broadcast(pairs)
    rec = records.where(F.col(name_col) != "").select("*", normalize_bn(name_col).alias("_a"))
    qs = queries.where(F.col(query_col) != "").select("*", normalize_bn(query_col).alias("_b"))
    qside = F.broadcast(qs) if strategy == "broadcast" else qs
    return rec.join(pairs, "_a", "inner").join(qside, "_b", "inner").drop("_a", "_b")
