"""Box mode: A4 page text from words, J2/W1 word lookup, A8, A2, A3, X3.

For every token of a matched record's name and guardian fields, the best
OCR word of the same page is looked up (Indel ratio of the normalised
strings >= 70, highest score, earliest word on ties); a field's distinct
chosen words give its box (union) and, over both fields, the mean
confidence.  Lookup runs only for matched records (boxes never change which
records match).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollscan.functions.similarity import lcs_of_many
from rollscan.functions.text import normalize_bn, py_split, py_strip
from rollscan.operators.filters import filter_words
from rollscan.params import SearchParams
from rollscan.session import materialize, ship_package

# Pages with matched records up to so many bytes (of their paths, and what a row needs besides)
# are broadcast to the word scan, so that words of other pages are not shuffled.
BROADCAST_MAX_PAGE_BYTES = 64 * 1024 * 1024

RECORD_KEY = ["path", "page", "block_pos"]


def _text_from_items(items: Column, layout: str) -> Column:
    """Page text from its words sorted in reading order (A4).

    ``flat``: words joined by one space (reference).  ``lines``: one space
    inside a line, a newline between lines, a blank line between blocks.
    """
    if layout == "flat":
        return F.array_join(F.transform(items, lambda w: w["text"]), " ")

    def piece(w: Column, i: Column) -> Column:
        prev = items[i - 1]
        sep = (
            F.when(i == 0, F.lit(""))
            .when(prev["block_num"] != w["block_num"], F.lit("\n\n"))
            .when(
                (prev["par_num"] != w["par_num"]) | (prev["line_num"] != w["line_num"]), F.lit("\n")
            )
            .otherwise(F.lit(" "))
        )
        return F.concat(sep, w["text"])

    return F.array_join(F.transform(items, piece), "")


def _item(w) -> Column:
    if w is None:
        return F.struct("block_num", "par_num", "line_num", "word_pos", "text")
    return F.struct(
        w["block_num"].alias("block_num"),
        w["par_num"].alias("par_num"),
        w["line_num"].alias("line_num"),
        w["word_pos"].alias("word_pos"),
        w["text"].alias("text"),
    )


def page_texts(words: DataFrame, params: SearchParams | None = None) -> DataFrame:
    """A4: one text per page from its word rows (after the F6 word filter).

    Word rows of one page meet in one group; a page is bounded by one
    physical page's words.
    """
    params = params or SearchParams()
    kept = filter_words(words, params.min_confidence)
    if params.layout == "flat":
        items = F.array_sort(F.collect_list(F.struct("word_pos", "block_num", "par_num", "line_num", "text")))
    else:
        items = F.array_sort(F.collect_list(_item(None)))
    grouped = kept.groupBy("path", "page").agg(items.alias("_items"))
    text = _text_from_items(F.col("_items"), params.layout)
    return grouped.select("path", _file_of("path"), "page", text.alias("text"))


def page_texts_from_arrays(pages: DataFrame, params: SearchParams | None = None, words_col: str = "words") -> DataFrame:
    """A4 for pages that already hold their words as one array (``ocr_pages`` output):
    the same text, built row by row without regrouping the words."""
    params = params or SearchParams()
    floor = F.lit(float(params.min_confidence))
    kept = F.filter(
        F.transform(F.col(words_col), lambda w: w.withField("text", py_strip(w["text"]))),
        lambda w: (w["text"] != "") & (w["confidence"] >= floor),
    )
    if params.layout == "flat":
        items = F.array_sort(
            F.transform(
                kept,
                lambda w: F.struct(
                    w["word_pos"].alias("word_pos"), w["block_num"].alias("block_num"),
                    w["par_num"].alias("par_num"), w["line_num"].alias("line_num"), w["text"].alias("text"),
                ),
            )
        )
    else:
        items = F.array_sort(F.transform(kept, _item))
    text = _text_from_items(F.col("_items"), params.layout)
    return pages.select("path", "page", items.alias("_items")).select(
        "path", _file_of("path"), "page", text.alias("text")
    )


def _file_of(path: str) -> Column:
    return F.element_at(F.split(F.col(path), "/", -1), -1).alias("file")


def record_tokens(records: DataFrame, key: list[str]) -> DataFrame:
    """Tokens of the name and guardian fields (``str.split()``), with positions."""
    fields = F.array(
        F.struct(F.lit("name").alias("field"), py_split(F.col("name")).alias("toks")),
        F.struct(F.lit("father").alias("field"), py_split(F.col("father")).alias("toks")),
    )
    by_field = records.select(*key, F.explode(fields).alias("f"))
    return by_field.select(
        *key,
        F.col("f.field").alias("field"),
        F.posexplode(F.col("f.toks")).alias("tok_pos", "token"),
    )


class PageIndex:
    """The words of one page by their normalised form, and the forms by length."""

    def __init__(self, forms: list[str]):
        """``forms`` in reading order; of equal forms only the earliest can be chosen."""
        self.first: dict[str, int] = {}
        for i, w in enumerate(forms):
            self.first.setdefault(w, i)
        self.by_length: dict[int, list[str]] = {}
        for w in self.first:
            self.by_length.setdefault(len(w), []).append(w)

    def best(self, token: str, threshold: int) -> tuple[int, float] | None:
        """W1 + F11: place and score of the word with the highest ratio >= threshold, the earliest on ties.

        Only an equal form scores 100.  Other lengths are tried from the one
        that can score highest down to where even a contained form would be
        below the threshold or the best so far.
        """
        if token in self.first:
            return self.first[token], 100.0
        n, best, place = len(token), 0.0, -1
        reach = lambda m: 200.0 * min(n, m) / (n + m) if n + m else 100.0
        for m in sorted(self.by_length, key=reach, reverse=True):
            if reach(m) < max(best, threshold) or not n or not m:
                break
            forms = self.by_length[m]
            for w, common in zip(forms, lcs_of_many(token, forms)):
                score = 200.0 * common / (n + m)
                if 200 * common >= threshold * (n + m) and (score > best or score == best and self.first[w] < place):
                    best, place = score, self.first[w]
        return (place, best) if best > 0 else None


def best_words(tokens: DataFrame, words: DataFrame, threshold: int, key: list[str]) -> DataFrame:
    """J2 + W1 + F11: per token, the page word with the highest ratio >= threshold.

    Tokens and words of a page meet once, co-grouped by (path, page): one index
    of the page's words answers every distinct token, exactly or by score.
    Words are exchanged once; those of pages without tokens only if the list of
    pages is beyond the broadcast check.
    """
    ship_package(tokens.sparkSession)
    t = int(threshold)
    asked = tokens.select(*key, "field", "tok_pos", normalize_bn("token").alias("_t"))
    pages = tokens.select("path", "page").distinct()
    size = pages.agg(F.sum(F.octet_length("path") + F.lit(64))).first()[0] or 0
    held = words.select("path", "page", "word_pos", F.col("text").alias("w_text"), F.col("confidence").alias("w_conf"),
                        F.col("bbox").alias("w_bbox"), normalize_bn("text").alias("_w"))
    if size <= BROADCAST_MAX_PAGE_BYTES:
        held = held.join(F.broadcast(pages), ["path", "page"], "left_semi")
    out = T.StructType([asked.schema[c] for c in [*key, "field", "tok_pos"]] + [
        T.StructField("word_pos", words.schema["word_pos"].dataType), T.StructField("w_text", T.StringType()),
        T.StructField("w_conf", T.DoubleType()), T.StructField("w_bbox", words.schema["bbox"].dataType), T.StructField("w_score", T.DoubleType()),
    ])
    named = [*key, "field", "tok_pos"]

    def look_up(tokens: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("word_pos")
        index, found = PageIndex(words["_w"].to_pylist()), {}
        for token in set(tokens["_t"].to_pylist()):
            found[token] = index.best(token, t)
        hits = [found[token] for token in tokens["_t"].to_pylist()]
        kept = tokens.select(named).filter(pa.array([h is not None for h in hits], pa.bool_()))
        chosen = words.take(pa.array([h[0] for h in hits if h], pa.int64()))
        for c in ("word_pos", "w_text", "w_conf", "w_bbox"):
            kept = kept.append_column(c, chosen[c])
        return kept.append_column("w_score", pa.array([h[1] for h in hits if h], pa.float64()))

    return asked.groupBy("path", "page").cogroup(held.groupBy("path", "page")).applyInArrow(look_up, out)


def field_boxes(best: DataFrame, key: list[str]) -> DataFrame:
    """A8 + A2 + A3: distinct chosen words per field → box per field, mean confidence."""
    distinct_words = best.select(*key, "field", "w_text", "w_conf", "w_bbox").dropDuplicates()
    per_field = distinct_words.groupBy(*key, "field").agg(
        F.min("w_bbox.left").alias("l"),
        F.min("w_bbox.top").alias("t"),
        F.max(F.col("w_bbox.left") + F.col("w_bbox.width")).alias("r"),
        F.max(F.col("w_bbox.top") + F.col("w_bbox.height")).alias("b"),
        F.sum("w_conf").alias("conf_sum"),
        F.count(F.lit(1)).alias("n"),
    )
    box = F.struct(
        F.col("l").alias("left"),
        F.col("t").alias("top"),
        (F.col("r") - F.col("l")).alias("width"),
        (F.col("b") - F.col("t")).alias("height"),
    )
    return per_field.groupBy(*key).agg(
        F.max(F.when(F.col("field") == "name", box)).alias("name_bbox"),
        F.max(F.when(F.col("field") == "father", box)).alias("father_bbox"),
        (F.sum("conf_sum") / F.sum("n")).alias("confidence"),
    )


def locate_records(
    matches: DataFrame,
    words: DataFrame,
    params: SearchParams | None = None,
    key: list[str] | None = None,
    materialize_matches: bool = True,
) -> DataFrame:
    """X3 for matched records: add ``name_bbox``, ``father_bbox``, ``confidence`` and ``bbox``.

    The matched rows are written once to the shared checkpoint folder (the
    list of pages, the word lookup and the final join all read them, and the
    lineage behind them is the whole search).
    """
    params = params or SearchParams()
    key = key or [c for c in RECORD_KEY + ["record_pos"] if c in matches.columns]
    if materialize_matches:
        matches = materialize(matches)
    recs = matches.select(*key, "name", "father").dropDuplicates(key)
    tokens = record_tokens(recs, key)
    kept = filter_words(words, params.min_confidence)
    best = best_words(tokens, kept, params.word_match_threshold, key)
    boxes = field_boxes(best, key)
    # one box row per matched record: AQE broadcasts it when its measured size allows
    out = matches.join(boxes, key, "left")
    return out.withColumn("bbox", F.col("name_bbox"))
