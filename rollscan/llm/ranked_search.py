"""Ranked lexical search: MaxScore with bounds of single terms and of term pairs.

1. Statistics: every document is cut into terms once; the postings of the query
   terms are kept in blocks of up to ``block_docs`` documents, the counts N, L and
   the document frequencies are sums over all documents.
2. Index: a block knows the exact integer impact of every posting.  A query's
   terms are paired in the order of their weights.  For every group of
   ``group_docs`` documents a term's list has its largest impact, and a pair's
   intersection list, in the groups where some document holds both terms, has
   the largest impact that they reach together in one document.
3. Search: a pair adds at most the greater of its joint maximum and its two single
   ones; summed over the pairs this bounds a group far below the sum of all single
   maxima.  Groups below the query's k-th score so far are skipped.  In the others
   the pairs that could not lift a document to that score by themselves are
   not essential: documents come from the essential pairs' postings only, and the
   rest is looked up, pair by pair, for those that the remaining bound leaves.
4. Every task keeps its k best per query and hands them to one ranking, which
   Spark limits before its shuffle.

Queries go in sets of about ``QUERY_CHARS`` characters, so what the driver and
the tasks hold is bounded by that and by the longest query, never by the documents.

Defined results: a null or empty text has no terms, is not counted in N and
never found; rows that share an item_id (null included) are one item with the
terms of all of them; an item without terms, or whose terms no document holds,
has no rows; repeated doc_id rows are documents of their own, and null ids come
last among equal scores; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollscan.llm.common import prepare, text_or_empty
from rollscan.session import materialize

K = 50
#: Characters of a set of queries, about.
QUERY_CHARS = 8_000_000
#: Bytes of a term: digits, letters (A-Z lower-cased) and all beyond ASCII; every other byte separates.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Sizes:
    """How the index is cut; results do not depend on it."""

    #: Documents of a block, and postings after which a block ends earlier.
    block_docs: int = 8192
    block_postings: int = 2_000_000
    #: Documents that share a bound.
    group_docs: int = 64
    #: Groups that are scored first, to raise the k-th score before the others are looked at.
    first_groups: int = 4


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split()


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def length_norms(lengths: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with so many terms."""
    wide = lengths if not len(lengths) or 50 * int(lengths.max()) * docs < 1 << 63 else lengths.astype(object)
    return 50 + (50 * wide * docs // total).astype(np.int64)


def impacts(weights: np.ndarray, tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return weights * (1_000_000_000 * tf // (1000 * tf + 20 * norms))


@dataclass
class Query:
    """Terms by falling weight (term numbers, two by two a pair; the last may stand alone as -1) and the numbers of the pairs."""

    item: int
    first: np.ndarray
    second: np.ndarray
    pairs: np.ndarray


class QuerySet:
    """Queries that are answered together: their terms and, once the corpus is counted, weights and pairs."""

    def __init__(self, items: list[tuple[object, list[bytes]]]) -> None:
        self.ids = [i for i, _ in items]
        self.vocabulary = {t: n for n, t in enumerate(sorted({t for _, found in items for t in found}))}
        self.terms = [sorted({self.vocabulary[t] for t in found}) for _, found in items]

    def weigh(self, docs: int, total: int, frequency: dict[int, int]) -> None:
        self.docs, self.total = docs, total
        self.weights = np.array([weight(frequency.get(n, 0), docs) for n in range(len(self.vocabulary))], np.int64)
        numbers: dict[tuple[int, int], int] = {}
        self.queries = []
        for item, found in enumerate(self.terms):
            held = sorted((n for n in found if frequency.get(n, 0)), key=lambda n: (-self.weights[n], n))
            held += [-1] * (len(held) % 2)
            pairs = [numbers.setdefault(p, len(numbers)) for p in zip(held[::2], held[1::2])]
            self.queries.append(Query(item, np.array(held[::2], int), np.array(held[1::2], int), np.array(pairs, int)))
        self.pairs = list(numbers)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], sizes: Sizes = Sizes()) -> DataFrame:
    """Blocks of documents: counts of all their terms, and the postings (term, document in block, tf) of the vocabulary.

    A block row has docs and total (documents with terms, and their terms, all
    of them), ids and lengths (of those that hold a term of the vocabulary),
    terms, starts (of each term's postings), of_doc and tf.
    """

    def block(held: list, docs: int, total: int) -> pa.RecordBatch:
        number = np.concatenate([h[2] for h in held]) if held else np.empty(0, np.int64)
        of_doc = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        tf = np.concatenate([h[3] for h in held]) if held else np.empty(0, np.int64)
        order = np.argsort(number, kind="stable")
        found, starts = np.unique(number[order], return_index=True)
        lists = [
            pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()),
            *(pa.array(v, pa.int32()) for v in (found, starts, of_doc[order], tf[order])),
        ]
        columns = [pa.array([v], pa.int64()) for v in (docs, total)]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
        return pa.RecordBatch.from_arrays(columns, ["docs", "total", "ids", "lengths", "terms", "starts", "of_doc", "tf"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, total, size = [], 0, 0, 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                words = terms(text.as_py())
                docs, total = docs + bool(words), total + len(words)
                known = [n for n in map(vocabulary.get, words) if n is not None]
                if known:
                    number, tf = np.unique(np.array(known), return_counts=True)
                    held.append((doc_id, len(words), number, tf))
                    size += len(number)
                if len(held) >= sizes.block_docs or size >= sizes.block_postings:
                    yield block(held, docs, total)
                    held, docs, total, size = [], 0, 0, 0
        if docs:
            yield block(held, docs, total)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    of = ", ".join(f"{c} array<{'long' if c in ('ids', 'lengths') else 'int'}>" for c in ("ids", "lengths", "terms", "starts", "of_doc", "tf"))
    return slim.mapInArrow(build, f"docs long, total long, {of}")


def corpus_counts(blocks: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L and the number of documents that hold each term of the vocabulary."""
    docs, total = blocks.agg(F.sum("docs"), F.sum("total")).first()
    ends = F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("of_doc")))
    df = F.zip_with(ends, "starts", lambda e, s: e - s)
    each = blocks.where(F.size("terms") > 0).select(F.explode(F.arrays_zip(F.col("terms").alias("term"), df.alias("df"))).alias("t"))
    found = each.select("t.term", "t.df").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row per query term
    return docs or 0, total or 0, {r["term"]: r["df"] for r in found}


INDEX = "ids array<long>, terms array<int>, starts array<int>, of_doc array<int>, impact array<long>, " \
    "tops array<long>, pairs array<int>, pair_groups array<int>, pair_tops array<long>"


def build_index(blocks: DataFrame, queries: QuerySet, sizes: Sizes = Sizes()) -> DataFrame:
    """The blocks with impacts, the largest by term and group, and the pairs' intersection lists with joint maxima."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                ids, lengths, found, starts, of_doc, tf = (
                    b.column(c)[i].values for c in ("ids", "lengths", "terms", "starts", "of_doc", "tf")
                )
                if not len(ids):
                    continue
                starts_, docs = starts.to_numpy(), of_doc.to_numpy().astype(np.int64)
                found_ = found.to_numpy()
                lists = np.append(starts_, len(docs))
                norms = length_norms(lengths.to_numpy(), queries.docs, queries.total)[docs]
                weights = np.repeat(queries.weights[found_], np.diff(lists))
                impact = impacts(weights, tf.to_numpy().astype(np.int64), norms)
                groups = -(-len(ids) // sizes.group_docs)
                tops = np.zeros((len(found_), groups), np.int64)
                np.maximum.at(tops, (np.repeat(np.arange(len(found_)), np.diff(lists)), docs // sizes.group_docs), impact)
                pairs, pair_groups, pair_tops = joint_maxima(queries.pairs, found_, lists, docs, impact, len(ids), sizes.group_docs)
                columns = [ids, found, starts, of_doc, *map(pa.array, (impact, tops.ravel()))]
                columns += [pa.array(v, kind) for v, kind in ((pairs, pa.int32()), (pair_groups, pa.int32()), (pair_tops, pa.int64()))]
                names = [c.split()[0] for c in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in columns], names)

    return blocks.mapInArrow(index, INDEX)


def joint_maxima(
    pairs: list[tuple[int, int]], found: np.ndarray, lists: np.ndarray, docs: np.ndarray, impact: np.ndarray, size: int, group_docs: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair number, group and largest joint impact, for the groups in which a document holds both terms of a pair."""
    place = {int(t): k for k, t in enumerate(found)}
    by_first: dict[int, list[tuple[int, int]]] = {}
    for number, (a, b) in enumerate(pairs):
        if a in place and b in place:
            by_first.setdefault(place[a], []).append((number, place[b]))
    of_a = np.full(size, -1, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, partners in by_first.items():
        own = slice(lists[a], lists[a + 1])
        of_a[docs[own]] = impact[own]
        for number, b in partners:
            other = slice(lists[b], lists[b + 1])
            both = of_a[docs[other]]
            held = both >= 0
            if held.any():
                group = docs[other][held] // group_docs  # ascending
                at = np.flatnonzero(np.diff(group, prepend=-1))
                top = np.maximum.reduceat((both + impact[other])[held], at)
                out.append((np.full(len(at), number), group[at], top))
        of_a[docs[own]] = -1
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


class Block:
    """A row of the index, ready for searching."""

    def __init__(self, row: dict[str, np.ndarray], terms: int, pairs: int, group_docs: int) -> None:
        self.group_docs = group_docs
        self.ids, self.missing = row["ids"], row["missing"]
        self.docs, self.impact = row["of_doc"].astype(np.int64), row["impact"]
        self.lists = np.append(row["starts"], len(self.docs))
        self.place = np.full(terms + 1, len(row["terms"]))  # the last, -1, and terms that are not here: an empty list
        self.place[row["terms"]] = np.arange(len(row["terms"]))
        self.groups = -(-len(self.ids) // group_docs)
        self.tops = np.vstack([row["tops"].reshape(-1, self.groups), np.zeros((1, self.groups), np.int64)])
        self.joint = np.zeros((pairs, self.groups), np.int64)
        self.joint[row["pairs"], row["pair_groups"]] = row["pair_tops"]

    def posting(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.place[term]
        if at == len(self.lists) - 1:
            return self.docs[:0], self.impact[:0]
        own = slice(self.lists[at], self.lists[at + 1])
        return self.docs[own], self.impact[own]

    def bounds(self, q: Query) -> np.ndarray:
        """By pair of the query and group: no document of the group gets more from the pair."""
        single = np.maximum(self.tops[self.place[q.first]], self.tops[self.place[q.second]])
        return np.maximum(single, self.joint[q.pairs])

    def scored(self, q: Query, bound: np.ndarray, groups: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of these groups whose score is ``least`` or more, with their scores."""
        rest = np.vstack([bound[::-1].cumsum(axis=0)[::-1], np.zeros((1, self.groups), np.int64)])  # of pair j and all after it
        essential = int((rest[:, groups].max(axis=1) >= least).sum())
        open_ = np.zeros(self.groups, bool)
        open_[groups] = True
        score = np.zeros(len(self.ids), np.int64)
        for j in range(essential):
            for term in (q.first[j], q.second[j]):
                docs, impact = self.posting(term)
                score[docs] += impact
        live = np.flatnonzero(score)
        live = live[open_[live // self.group_docs]]
        for j in range(essential, len(bound)):
            live = live[score[live] + rest[j, live // self.group_docs] >= least]
            for term in (q.first[j], q.second[j]):
                docs, impact = self.posting(term)
                if len(docs) and len(live):
                    at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
                    score[live] += np.where(docs[at] == live, impact[at], 0)
        live = live[score[live] >= least]
        return live, score[live]


class Best:
    """The k best documents of a query so far: score, whether the id is null, and id."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.missing, self.ids = k, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """Score that a further document must reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        score, missing, ids = np.append(self.score, score), np.append(self.missing, missing), np.append(self.ids, ids)
        order = np.lexsort((ids, missing, -score))[: self.k]
        self.score, self.missing, self.ids = score[order], missing[order], ids[order]


def search(block: Block, q: Query, best: Best, first_groups: int) -> None:
    """Add the block's documents that belong to the k best."""
    bound = block.bounds(q)
    upper = bound.sum(axis=0)
    order = np.argsort(-upper, kind="stable")
    for groups in (order[:first_groups], order[first_groups:]):
        groups = groups[upper[groups] >= best.least]
        if not len(groups):
            return
        docs, score = block.scored(q, bound, groups, best.least)
        best.add(score, block.missing[docs], block.ids[docs])


def top_of_tasks(index: DataFrame, queries: QuerySet, k: int, sizes: Sizes = Sizes()) -> DataFrame:
    """item (number in the set), doc_id and score: the k best of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries.queries]
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].values for c in b.schema.names}
                missing = row["ids"].is_null().to_numpy(zero_copy_only=False)
                row = {c: v.fill_null(0).to_numpy(zero_copy_only=False) for c, v in row.items()}
                block = Block(row | {"missing": missing}, len(queries.vocabulary), len(queries.pairs), sizes.group_docs)
                for q in queries.queries:
                    if len(q.first):
                        search(block, q, best[q.item], sizes.first_groups)
        item = np.repeat(np.arange(len(best)), [len(x.score) for x in best])
        ids = pa.array(np.concatenate([x.ids for x in best]), pa.int64(), mask=np.concatenate([x.missing for x in best]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), ids, pa.array(np.concatenate([x.score for x in best]), pa.int64())], ["item", "doc_id", "score"]
        )

    return index.mapInArrow(run, "item int, doc_id long, score long")


def query_sets(items: DataFrame, chars: int = QUERY_CHARS) -> Iterator[QuerySet]:
    """The items in sets of about so many characters."""
    named = items.select("item_id", text_or_empty().alias("text"))
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    sets = max(1, -(-total // chars))
    part = F.pmod(F.xxhash64("item_id"), F.lit(sets))
    for s in range(sets):
        found: dict[object, list[bytes]] = {}
        for r in named.where(part == s).toLocalIterator():  # one row of text at a time
            held = found.setdefault(r["item_id"], [])
            held[:] = {*held, *terms(r["text"])}
        if any(found.values()):
            yield QuerySet(list(found.items()))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, chars: int = QUERY_CHARS, sizes: Sizes = Sizes()) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the k best documents with a score above 0 for every item."""
    spark = docs.sparkSession
    prepare(spark)
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for queries in query_sets(items, chars):
        blocks = materialize(postings(docs, queries.vocabulary, sizes))
        count, total, frequency = corpus_counts(blocks)
        if not frequency:
            continue
        queries.weigh(count, total, frequency)
        index = materialize(build_index(blocks, queries, sizes))
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = top_of_tasks(index, queries, k, sizes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"item int, item_id {kind}")  # as many rows as queries in the set
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


def oracle_sql(k: int = K) -> str:
    """The same scores by scoring every document in DuckDB."""
    cut = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""
    WITH item_terms AS (SELECT DISTINCT item_id, unnest({cut}) AS term FROM benchmark),
    doc_terms AS (SELECT row_number() OVER () AS row, doc_id, {cut} AS terms FROM documents),
    lengths AS (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n FROM doc_terms WHERE len(terms) > 0),
    corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
    held AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(terms) AS term FROM doc_terms) GROUP BY row, term),
    weights AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM held, corpus GROUP BY term
    ),
    scores AS (
        SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS score
        FROM item_terms JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (row), corpus
        GROUP BY item_id, doc_id, row
    ),
    ranked AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id,
            CAST(score AS BIGINT) AS score
        FROM scores WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}
    """
