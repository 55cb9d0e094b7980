"""Stand-in roll tables derived from the driver's ``part`` table.

The driver's test tables hold no scanned rolls, so the queries registered in
``__spark_entry__`` build page texts, OCR word rows and name lists from
``part`` (every row, every SF).  These builders only lay out rows in the
schema the engine reads (``pages``, ``words``, ``queries``); they compute no
search result.  The engine's operators then run on them unchanged and must
be right for any data of that schema.

The same derivations are given as DuckDB SQL (``*_SQL``) for the oracle.

Layout (fixed values of the stand-in data, not of the engine):
* one roll file per 1000 part keys, five pages per file, at most 200 record
  blocks per page, blocks separated by one blank line in key order;
* block kind by key modulo 7: 0-2 name line then father line, 3 husband
  label, 4 father line first, 5 full-width colons and a tab between the
  name's words (a two-token name after normalisation), 6 name line only;
* OCR words: the page's whitespace tokens; block/line numbers from the
  text's blocks and lines; left = 10·pos, top = 20·line, width = 7·length,
  height = 12, confidence = 50 + (7·pos + 11·page) mod 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.params import SearchParams

NL = "\n"
KEYS_PER_FILE = 1000
KEYS_PER_PAGE = 200
PAGES_PER_FILE = 5


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand")


def roll_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, b = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    kind = k % 7
    name_line = F.concat(F.lit("নাম : "), n)
    father_line = F.concat(F.lit("পিতার নাম : "), b)
    block = (
        F.when(kind <= 2, F.concat(name_line, F.lit(NL), father_line))
        .when(kind == 3, F.concat(name_line, F.lit(NL), F.lit("স্বামীর নাম : "), b))
        .when(kind == 4, F.concat(father_line, F.lit(NL), name_line))
        .when(kind == 5, F.concat(F.lit("নাম ： "), F.translate(n, " ", "\t"), F.lit(NL), F.lit("পিতার নাম： "), b))
        .otherwise(name_line)
    )
    file = F.concat(
        F.lit("roll_"),
        F.lpad(F.expr(f"p_partkey div {KEYS_PER_FILE}").cast("string"), 5, "0"),
        F.lit(".pdf"),
    )
    page = (F.lit(1) + F.expr(f"(p_partkey div {KEYS_PER_PAGE}) % {PAGES_PER_FILE}")).cast("int")
    return _part(spark, sf_dir).select(
        F.concat(F.lit("/data/rolls/"), file).alias("path"),
        file.alias("file"),
        page.alias("page"),
        k.alias("k"),
        block.alias("block"),
    )


def roll_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages(path, file, page, text)``: blocks of a page joined by a blank line."""
    blocks = roll_blocks(spark, sf_dir)
    return blocks.groupBy("path", "file", "page").agg(
        F.concat_ws(
            NL + NL,
            F.transform(
                F.array_sort(F.collect_list(F.struct("k", "block"))), lambda s: s["block"]
            ),
        ).alias("text")
    )


def roll_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``queries(query)``: every distinct part name, the same without its first
    character, the same with its two words swapped, and swapped joined by a
    tab (a two-token query) (bag union)."""
    part = _part(spark, sf_dir)
    names = part.select(F.col("p_name").alias("query")).distinct()
    cut = part.select(F.substring("p_name", 2, 1 << 20).alias("query")).distinct()
    swapped = (
        part.where(F.col("p_name").contains(" "))
        .select(
            F.concat_ws(
                " ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))
            ).alias("query")
        )
        .distinct()
    )
    tabbed = (
        part.where(F.col("p_name").contains(" "))
        .select(
            F.concat_ws(
                "\t", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))
            ).alias("query")
        )
        .distinct()
    )
    return names.unionByName(cut).unionByName(swapped).unionByName(tabbed)


def roll_name_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-list files as whole texts: one text per roll file, one part name per
    line in key order, with a blank line and padding after every 10th name."""
    part = _part(spark, sf_dir)
    line = F.when(F.col("p_partkey") % 10 == 9, F.concat(F.lit("  "), F.col("p_name"), F.lit(NL)))
    line = line.otherwise(F.col("p_name"))
    return part.groupBy(F.expr(f"p_partkey div {KEYS_PER_FILE}").alias("file_no")).agg(
        F.concat_ws(
            NL,
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), line.alias("l")))),
                lambda s: s["l"],
            ),
        ).alias("value")
    ).select(
        F.concat(F.lit("/data/names/names_"), F.lpad(F.col("file_no").cast("string"), 5, "0"), F.lit(".txt")).alias("path"),
        "value",
    )


def roll_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``words`` rows from the page texts: one row per whitespace token."""
    pages = roll_pages(spark, sf_dir)
    blocks = pages.select(
        "path", "page", F.posexplode(F.split("text", NL + NL, -1)).alias("block_num", "block")
    )
    lines = blocks.select(
        "path", "page", "block_num", F.posexplode(F.split("block", NL, -1)).alias("line_num", "line")
    )
    toks = lines.select(
        "path",
        "page",
        "block_num",
        "line_num",
        F.posexplode(F.split(F.trim("line"), " +", -1)).alias("tok_pos", "text"),
    ).where(F.col("text") != "")
    # word_pos numbers tokens in reading order within the page; computed from
    # (block, line, token) without a page-wide window: blocks and lines are
    # short, so a fixed stride keeps the order.
    word_pos = (F.col("block_num") * 100 + F.col("line_num")) * 100 + F.col("tok_pos")
    # Laid out like a stored word table: spread over partitions by page.
    toks = toks.repartition(max(spark.sparkContext.defaultParallelism, 1), "path", "page")
    return toks.select(
        "path",
        F.col("page").cast("int").alias("page"),
        word_pos.cast("long").alias("word_pos"),
        F.col("block_num").cast("int").alias("block_num"),
        F.lit(1).alias("par_num"),
        F.col("line_num").cast("int").alias("line_num"),
        "text",
        (F.lit(50) + (F.col("tok_pos") * 7 + F.col("page") * 11) % 50).cast("double").alias("confidence"),
        F.struct(
            (F.col("tok_pos") * 10).cast("int").alias("left"),
            ((F.col("block_num") * 3 + F.col("line_num")) * 20).cast("int").alias("top"),
            (F.length("text") * 7).cast("int").alias("width"),
            F.lit(12).alias("height"),
        ).alias("bbox"),
    )


# ---------------------------------------------------------------------------
# DuckDB forms of the same derivations (oracle side)
# ---------------------------------------------------------------------------
ROLL_PAGES_SQL = f"""
roll_blocks AS (
  SELECT '/data/rolls/roll_' || lpad(CAST(p_partkey // {KEYS_PER_FILE} AS VARCHAR), 5, '0') || '.pdf' AS path,
         'roll_' || lpad(CAST(p_partkey // {KEYS_PER_FILE} AS VARCHAR), 5, '0') || '.pdf' AS file,
         CAST(1 + (p_partkey // {KEYS_PER_PAGE}) % {PAGES_PER_FILE} AS INTEGER) AS page,
         p_partkey AS k,
         CASE WHEN p_partkey % 7 <= 2 THEN 'নাম : ' || p_name || chr(10) || 'পিতার নাম : ' || p_brand
              WHEN p_partkey % 7 = 3 THEN 'নাম : ' || p_name || chr(10) || 'স্বামীর নাম : ' || p_brand
              WHEN p_partkey % 7 = 4 THEN 'পিতার নাম : ' || p_brand || chr(10) || 'নাম : ' || p_name
              WHEN p_partkey % 7 = 5 THEN 'নাম ： ' || replace(p_name, ' ', chr(9)) || chr(10) || 'পিতার নাম： ' || p_brand
              ELSE 'নাম : ' || p_name END AS block
  FROM part),
roll_pages AS (
  SELECT path, file, page, string_agg(block, chr(10) || chr(10) ORDER BY k) AS text
  FROM roll_blocks GROUP BY path, file, page)
"""

ROLL_QUERIES_SQL = """
roll_queries AS (
  SELECT query FROM (SELECT DISTINCT p_name AS query FROM part)
  UNION ALL SELECT query FROM (SELECT DISTINCT substr(p_name, 2) AS query FROM part)
  UNION ALL SELECT query FROM (SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS query
                               FROM part WHERE contains(p_name, ' '))
  UNION ALL SELECT query FROM (SELECT DISTINCT split_part(p_name, ' ', 2) || chr(9) || split_part(p_name, ' ', 1) AS query
                               FROM part WHERE contains(p_name, ' ')))
"""

ROLL_WORDS_SQL = """
roll_bl AS (
  SELECT path, page, b.i - 1 AS block_num, b.blk AS block
  FROM roll_pages, LATERAL (SELECT unnest(string_split(text, chr(10) || chr(10))) AS blk,
                                   generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i) b),
roll_li AS (
  SELECT path, page, block_num, l.i - 1 AS line_num, l.ln AS line
  FROM roll_bl, LATERAL (SELECT unnest(string_split(block, chr(10))) AS ln,
                                generate_subscripts(string_split(block, chr(10)), 1) AS i) l),
roll_tok AS (
  SELECT path, page, block_num, line_num, t.i - 1 AS tok_pos, t.tok AS text
  FROM roll_li, LATERAL (SELECT unnest(regexp_split_to_array(trim(line), ' +')) AS tok,
                                generate_subscripts(regexp_split_to_array(trim(line), ' +'), 1) AS i) t),
roll_words AS (
  SELECT path, CAST(page AS INTEGER) AS page,
         CAST((block_num * 100 + line_num) * 100 + tok_pos AS BIGINT) AS word_pos,
         CAST(block_num AS INTEGER) AS block_num, 1 AS par_num, CAST(line_num AS INTEGER) AS line_num,
         text, CAST(50 + (tok_pos * 7 + page * 11) % 50 AS DOUBLE) AS confidence,
         CAST(tok_pos * 10 AS INTEGER) AS bbox_left,
         CAST((block_num * 3 + line_num) * 20 AS INTEGER) AS bbox_top,
         CAST(length(text) * 7 AS INTEGER) AS bbox_width, 12 AS bbox_height
  FROM roll_tok WHERE text <> '')
"""


# ---------------------------------------------------------------------------
# File-level stand-ins from ``documents``: one "PDF" file per document
# ---------------------------------------------------------------------------
# Fixed "now" of the ledger stand-in and its queries (repeatable runs).
LEDGER_NOW = "2026-01-01 00:00:00"
LINES_PER_PAGE = 4


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``binaryFile``-shaped rows (``path, modificationTime, length, content``).

    Suffix by doc_id mod 5 (0 → ``.txt``, 1 → ``.PDF``, else ``.pdf``); every
    13th path takes a ``/../src1`` detour; doc_id mod 9 = 4 lacks the PDF
    header.  Content is the UTF-8 text after a ``%PDF-1.7`` line.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    ext = F.when(F.col("doc_id") % 5 == 0, ".txt").when(F.col("doc_id") % 5 == 1, ".PDF").otherwise(".pdf")
    detour = F.when(F.col("doc_id") % 13 == 0, "/../src1").otherwise("")
    path = F.concat(
        F.lit("/data/"), F.col("source"), detour, F.lit("/doc_"),
        F.lpad(F.col("doc_id").cast("string"), 7, "0"), ext,
    )
    body = F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("NOT A PDF "), F.col("text"))).otherwise(
        F.concat(F.lit("%PDF-1.7\n"), F.col("text"))
    )
    content = F.encode(body, "UTF-8")
    return d.select(
        path.alias("path"),
        F.lit(LEDGER_NOW).cast("timestamp").alias("modificationTime"),
        F.octet_length(content).cast("long").alias("length"),
        content.alias("content"),
        "doc_id",
    )


def text_page_fn(path: str, content: bytes):
    """Stand-in page function for T1 (where a user plugs the OCR engine).

    Pages are runs of four lines of the text after the header line; a page
    holding an ``@`` is reported as a failed page.
    """
    from rollscan.sources.ocr import PageError

    text = content.decode("utf-8")
    lines = text.split("\n")[1:]
    for i in range(0, len(lines), LINES_PER_PAGE):
        page = "\n".join(lines[i : i + LINES_PER_PAGE])
        yield PageError("page holds an e-mail address") if "@" in page else page


def roll_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``binaryFile``-shaped rows of the rolls: a PDF header line, then the pages of a roll, form feeds between."""
    pages = roll_pages(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    body = F.concat(F.lit("%PDF-1.7\n"), F.array_join(F.transform("p", lambda x: x["text"]), "\f"))
    content = F.encode(body, "UTF-8")
    return pages.select(
        "path", F.lit(LEDGER_NOW).cast("timestamp").alias("modificationTime"),
        F.octet_length(content).cast("long").alias("length"), content.alias("content"),
    )


def roll_page_fn(path: str, content: bytes):
    """Stand-in page function of roll files: pages at form feeds; a page of one ``?`` is a failed one."""
    from rollscan.sources.ocr import PageError

    for page in content.decode("utf-8").split("\n", 1)[1].split("\f"):
        yield PageError("unreadable") if page == "?" else page


def write_files(files: DataFrame, folder: str) -> str:
    """Write ``files(name, content)`` as files of a folder, each in the task that holds its row."""
    import pyarrow as pa

    from rollscan.session import ship_package
    from rollscan.sources.planned import open_file, split_uri

    ship_package(files.sparkSession)

    def write(batches):
        import os

        scheme, _, local = split_uri(folder)
        if not scheme:
            os.makedirs(local, exist_ok=True)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                with open_file(f"{folder}/{name}", "wb") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], ["n"])

    files.select("name", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


def roll_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(name, content)``: every roll as a "PDF"; the pages of every fifth one are followed by an unreadable
    one, and every seventh has a copy without a PDF header."""
    rolls = roll_files(spark, sf_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    number = F.substring("name", 6, 5).cast("int")
    text = F.decode("content", "UTF-8")
    whole = rolls.select("name", F.encode(F.when(number % 5 == 0, F.concat(text, F.lit("\f?"))).otherwise(text), "UTF-8").alias("content"))
    broken = rolls.where(number % 7 == 0).select(F.concat(F.lit("bad_"), "name").alias("name"), F.encode(F.substring(text, 2, 1 << 30), "UTF-8").alias("content"))
    return whole.unionByName(broken)


def document_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(name, content)`` of the document files, in folders by source."""
    return doc_files(spark, sf_dir).select(F.concat_ws("_", F.element_at(F.split("path", "/"), 3), F.element_at(F.split("path", "/"), -1)).alias("name"), "content")


def doc_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages(path, file, page, text, level, message)`` of the document files as an OCR step leaves them, laid out natively:
    pages of four lines; one with an ``@`` is a page error, a file without PDF header a file error."""
    from rollscan.operators.filters import pdf_suffix
    from rollscan.sources.files import validate_files
    from rollscan.sources.ocr import MSG_PAGE

    files = validate_files(doc_files(spark, sf_dir).where(pdf_suffix("path")))
    lines = F.split(F.substring(F.decode("content", "UTF-8"), 10, 1 << 30), NL, -1)
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(LINES_PER_PAGE))
    texts = F.transform(starts, lambda i: F.array_join(F.slice("lines", i, F.lit(LINES_PER_PAGE)), NL))
    pages = files.where("error is null").select("path", "file", lines.alias("lines"))
    pages = pages.select("path", "file", F.posexplode(texts).alias("at", "text")).withColumn("page", (F.col("at") + 1).cast("int"))
    failed = F.contains("text", F.lit("@"))
    message = F.concat(F.lit(MSG_PAGE.split("{page}")[0]), F.col("page").cast("string"), F.lit(": page holds an e-mail address"))
    pages = pages.select(
        "path", "file", "page", F.when(~failed, F.col("text")).alias("text"),
        F.when(failed, "page").alias("level"), F.when(failed, message).alias("message"),
    )
    none = F.lit(None).cast("string")
    bad = files.where("error is not null").select(
        "path", "file", F.lit(None).cast("int").alias("page"), none.alias("text"), F.lit("file").alias("level"),
        F.concat("file", F.lit(": "), "error").alias("message"),
    )
    return pages.unionByName(bad)


def word_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(name, content)``: the OCR engine's TSV output of every roll: a header, a row of level 1 and no
    confidence for every page, and the words; every tenth one ends in a quote."""
    w = roll_words(spark, sf_dir)
    number = F.col("tok_pos_") + 1
    w = w.withColumn("tok_pos_", F.pmod("word_pos", F.lit(100)))
    bare = F.translate("text", "\t", "_")  # a word of the OCR engine holds no white space
    text = F.when(F.pmod(F.col("word_pos"), F.lit(10)) == 3, F.concat(bare, F.lit('"'))).otherwise(bare)
    boxed = [F.col(f"bbox.{c}") for c in ("left", "top", "width", "height")]
    cells = [F.lit(5), F.col("page"), F.col("block_num"), F.col("par_num"), F.col("line_num"), number, *boxed, F.col("confidence"), text]
    words = w.select("path", "page", "word_pos", F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("line"))
    heads = w.select("path", "page").distinct().select(
        "path", "page", F.lit(-1).cast("long").alias("word_pos"),
        F.concat(F.lit("1\t"), F.col("page").cast("string"), F.lit("\t0\t0\t0\t0\t0\t0\t100\t100\t-1\t")).alias("line"),
    )
    rows = words.unionByName(heads).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page", "word_pos", "line"))).alias("r"))
    header = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    body = F.concat(F.lit(header + NL), F.array_join(F.transform("r", lambda x: x["line"]), NL), F.lit(NL))
    return rows.select(F.concat(F.element_at(F.split("path", "/"), -1), F.lit(".tsv")).alias("name"), F.encode(body, "UTF-8").alias("content"))


# Words: runs of letters of any script.
NO_LETTERS = "[^\\p{L}]+"


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``records(path, page, block_pos, name)`` of high cardinality: every distinct word of all documents, as a name
    on a page of its own."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", NO_LETTERS)).alias("name"))
    words = d.where("name <> ''").distinct()
    return words.select(
        F.concat(F.lit("/data/words/"), F.col("name")).alias("path"), F.lit(1).alias("page"), F.lit(0).alias("block_pos"), "name"
    )


def benchmark_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``queries(query)``: every distinct word of the benchmark texts."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.split("text", NO_LETTERS)).alias("query"))
    return b.where("query <> ''").distinct()


def doc_ledger(spark: SparkSession, sf_dir: str, nhash: str) -> DataFrame:
    """Ledger entries "written by earlier runs" for the document files.

    threshold 90 when doc_id mod 3 = 0 else 82; version 0.9 when doc_id
    mod 11 = 0; age doc_id mod 45 days; no results when doc_id mod 4 = 0;
    every 7th file also has an older, superseded entry.
    """
    f = doc_files(spark, sf_dir)
    now = F.lit(LEDGER_NOW).cast("timestamp")
    item = F.struct(
        F.lit("old_name.pdf").alias("file"),
        F.lit(1).alias("page"),
        F.concat(F.lit("name "), F.col("doc_id").cast("string")).alias("name"),
        F.lit("guardian").alias("father"),
        F.lit(None).cast("struct<left:int,top:int,width:int,height:int>").alias("bbox"),
        F.lit(None).cast("double").alias("confidence"),
    )

    def entry(age_extra: int, page: int) -> DataFrame:
        it = item.withField("page", F.lit(page))
        return f.select(
            F.sha2("content", 256).alias("file_hash"),
            F.lit(nhash).alias("names_hash"),
            F.when(F.col("doc_id") % 3 == 0, 90).otherwise(82).alias("threshold"),
            F.lit(False).alias("box_level"),
            F.lit(60.0).alias("min_confidence"),
            # entries of other settings: F5's cap was 5 pages when doc_id mod 13 = 0
            F.when(F.col("doc_id") % 13 == 0, SearchParams(max_pdf_pages=5).settings())
            .otherwise(SearchParams().settings()).alias("settings"),
            F.when(F.col("doc_id") % 11 == 0, "0.9").otherwise("1.0").alias("version"),
            (now - F.make_dt_interval(((F.col("doc_id") % 45) + age_extra).cast("int"))).alias("ts"),
            F.col("path").alias("pdf_path"),
            F.lit("old_name.pdf").alias("pdf_name"),
            F.lit(192).alias("num_names"),
            F.when(F.col("doc_id") % 4 == 0, F.array().cast(f"array<{item_type()}>"))
            .otherwise(F.array(it))
            .alias("results"),
            "doc_id",
        )

    return entry(0, 1).unionByName(entry(1, 2).where(F.col("doc_id") % 7 == 0)).drop("doc_id")


def item_type() -> str:
    from rollscan.schemas import RESULT_ITEM

    return RESULT_ITEM.simpleString()


WORD_NAMES_SQL = """
word_names AS (
  SELECT DISTINCT name FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{L}]+')) AS name FROM documents) WHERE name <> ''),
word_queries AS (
  SELECT DISTINCT query FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{L}]+')) AS query FROM benchmark) WHERE query <> '')
"""

DOC_FILES_SQL = """
doc_files AS (
  SELECT doc_id,
         '/data/' || source || CASE WHEN doc_id % 13 = 0 THEN '/../src1' ELSE '' END || '/doc_'
           || lpad(CAST(doc_id AS VARCHAR), 7, '0')
           || CASE WHEN doc_id % 5 = 0 THEN '.txt' WHEN doc_id % 5 = 1 THEN '.PDF' ELSE '.pdf' END AS path,
         encode(CASE WHEN doc_id % 9 = 4 THEN 'NOT A PDF ' || text ELSE '%PDF-1.7' || chr(10) || text END) AS content
  FROM documents)
"""
