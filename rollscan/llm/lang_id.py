"""Language identification by compression.

For every language a zstandard raw-content dictionary is made of sample
passages of its labelled training rows.  A text is compressed with each
dictionary; the language whose dictionary makes it smallest is chosen, and
the choice is rejected when the runner-up is nearly as small.  Long texts are
compressed passage by passage, all of them, so that the dictionary and not
the text's own beginning decides.  Texts and samples are lower-cased first.

The training sample is bounded: the ``LANGUAGES`` values of ``lang`` with most
training rows (ties by name; any other value is never predicted), ``PASSAGES``
documents of each, taken by a hash of their ids among all training rows, one
passage of at most ``PASSAGE_CHARS`` characters from each, likewise by hash.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without any training row every text is; with one learned language every text
with a letter is that language with score 1; rows with null or repeated
``doc_id`` are classified like any other (rows with a null id are never
learned from); ties go to the language with more training rows, then to the
first by name; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollscan.llm.common import prepare

LANGUAGES = 200
PASSAGES = 128
PASSAGE_CHARS = 2000
#: Bytes of a text that are compressed at a time.
PASSAGE_BYTES = 4096
LEVEL = 9
#: A choice is rejected if the second-smallest result is less than this share larger.
MIN_MARGIN = 0.01
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")
    )


def sample_passages(docs: DataFrame, passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> DataFrame:
    """lang, passage: the bounded training sample."""
    rows = training_rows(docs)
    # the limit by rank is applied in each task before rows are exchanged
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = rows.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= passages)
    chosen = ids.select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang")).distinct()
    mine = (F.col("doc_id") == F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang"))
    texts = rows.join(F.broadcast(chosen), mine, "left_semi").dropDuplicates(["doc_id", "lang"])
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    part = F.get(parts, F.pmod(F.xxhash64("doc_id", "lang"), F.size(parts)).cast("int"))
    return texts.select("lang", part.alias("passage"), F.xxhash64("doc_id").alias("place"))


def learn(docs: DataFrame, languages: int = LANGUAGES, **options) -> dict[str, bytes]:
    """Dictionary content of each language, at most PASSAGES * PASSAGE_CHARS characters of it; frequent languages first."""
    counted = training_rows(docs).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages)
    order = [r["lang"] for r in counted.collect()]
    found: dict[str, list] = {k: [] for k in order}
    for r in sample_passages(docs.where(F.col("lang").isin(order)), **options).collect():
        found[r["lang"]].append((r["place"], r["passage"]))
    return {k: "\n".join(p for _, p in sorted(found[k])).lower().encode("utf-8", "surrogatepass") for k in order}


class Judge:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.languages = list(contents)
        self.compressors = []
        for data in contents.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(
                zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and the relative margin to the second; und and 0 if there is nothing to judge."""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        data = text.lower().encode("utf-8", "surrogatepass")
        parts = [data[i : i + PASSAGE_BYTES] for i in range(0, len(data), PASSAGE_BYTES)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), i) for i, c in enumerate(self.compressors))
        return self.languages[sizes[0][1]], 1.0 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def identify(docs: DataFrame, contents: dict[str, bytes], level: int = LEVEL, min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (relative margin, 0 to 1) and rejected."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(contents)  # bounded by the sample

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Judge(shared.value, level)
        for b in batches:
            found = [of(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [k for k, _ in found], "score": [s for _, s in found]})

    slim = docs.select(F.col("doc_id").cast("string"), "text")  # a null id would turn integers into floats
    judged = slim.mapInPandas(judge, "doc_id string, lang_pred string, score double")
    return judged.select(
        F.col("doc_id").cast(kind), "lang_pred", "score",
        ((F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_margin)).alias("rejected"),
    )
