"""License scans by canonical digest.

Known licence texts and notices are brought to a canonical form: lower case,
copyright lines gone, equivalent spellings made one, every run of other
characters than letters and digits one space.  A document is brought to the
same form twice: its whole text, which finds documents that are a licence,
and each of its lines, which finds notices inside documents.  The SHA-256
digests are joined by hash to those of the known texts; nothing is compared
approximately, so a changed word is another text.

Everything is DataFrame expressions.  The known digests are broadcast if
they are few (``BROADCAST_ROWS``; the built-in list is a fixed one), else the
join shuffles.  Documents are joined line by line but only one small row per
document and task is shuffled, never a text.

Defined results: null and empty texts and lines without letters or digits
match nothing; rows with null or repeated ``doc_id`` are
scanned like any other, one output row per input row; other input columns
are ignored.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscan.llm.common import text_or_empty

BROADCAST_ROWS = 100_000

#: Equivalent spellings, the right one canonical (fixed values, after the public matching guidelines for licences).
SPELLINGS = (
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("whilst", "while"),
    ("organisation", "organization"),
    ("per cent", "percent"),
)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
#: Known texts by licence id (fixed values: the public texts of the licences and of common notices).
TEXTS = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.\n\n" + _ISC_WARRANTY,
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Licences whose identifier and name make notices by rule: SPDX identifiers, and the names in "Licensed under the ...".
NAMES = {
    "MIT": ("MIT License",), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",), "Unlicense": ("Unlicense",),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"),
    "GPL-2.0": ("GNU General Public License v2.0", "GNU General Public License, version 2"),
    "GPL-3.0": ("GNU General Public License v3.0", "GNU General Public License, version 3"),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3"),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License",),
    "AGPL-3.0": ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License",),
}
#: Identifiers that SPDX lines offer as a choice of two, in either order.
CHOICES = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-or-later", "LGPL-2.1-or-later")
#: Opening words of a line that names a licence.
OPENINGS = ("Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.")


def spdx_forms(license_id: str) -> tuple[str, ...]:
    """Identifiers of a licence in SPDX lines: those of the GNU family say whether later versions are meant."""
    gnu = license_id.startswith(("GPL", "LGPL", "AGPL"))
    return tuple(license_id + end for end in ("", "-only", "-or-later", "+")) if gnu else (license_id,)


def notices() -> tuple:
    """SPDX lines of one licence, of a choice of two (an expression of its own), and sentences that name one."""
    one = [(k, f"SPDX-License-Identifier: {form}") for k in NAMES for form in spdx_forms(k)]
    two = [(f"{a} OR {b}", f"SPDX-License-Identifier: {a} OR {b}") for a in CHOICES for b in CHOICES if a != b]
    named = [(k, opening.format(name)) for k, names in NAMES.items() for name in names for opening in OPENINGS]
    return tuple(one + two + named)


KNOWN = TEXTS + notices()

#: Entire texts in the folder license_texts, by licence id.
ENTIRE = ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")
#: Titles that files put above a text which has none of its own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero-Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
UNLICENSE_URLS = ("<https://unlicense.org>", "<https://unlicense.org/>", "<http://unlicense.org>", "<http://unlicense.org/>")
#: Last line of texts without their appendix on how to apply them.
TERMS_END = "END OF TERMS AND CONDITIONS"

#: Words after "copyright" at the start of a line that go on with a clause; other lines that begin so are copyright statements.
CLAUSE = (
    "notices?|holders?|owners?|licen[cs]es?|laws?|and|or|in|is|interests?|statements?|rights?|protection|to|of|as|on|for|"
    "permission|claims?|infringement|treaty|acts?|material|status|disclaimer|that|which|may|shall|will|does|are|was|has"
)
#: Words after "(c)" that make it the mark of a list entry.
LISTED = "you|your|if|for|under|any|to|in|it|that|is|are|must|may|shall|where|when|the (?:licen[cs]e|work|copyright)"
COPYRIGHT_LINE = (
    rf"(?m)^[^\p{{L}}\p{{N}}\n]*(copyright (?!\s*(?:{CLAUSE})(?![\p{{L}}\p{{N}}]))[^\n]*|"
    rf"\(c\) (?!\s*(?:{LISTED}))[^\n]*|©[^\n]*|all rights reserved[^\n]*)$"
)
#: Names that users fill into the texts, in canonical form, and the names that stand for them.
FILLED = (
    (r"neither the name of [^\n]+? nor the names of (?:its|the) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"this software is provided by [^\n]+? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (r"in no event shall [^\n]+? be liable for any direct", "in no event shall the copyright holder or contributors be liable for any direct"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if no letter or digit is left."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for other, one in FILLED:
        out = F.regexp_replace(out, other, one)
    return out


def entire_texts() -> tuple:
    """Known texts as whole files: (license, text) with the titles, bullets and endings that are in use."""
    folder = files("rollscan.llm") / "license_texts"
    texts = [(k, (folder / f"{k}.txt").read_text("utf-8")) for k in ENTIRE]
    bsd = dict(texts)["BSD-3-Clause"]
    texts.append(("BSD-2-Clause", re.sub(r"(?s)3\. Neither .*?permission\.\n", "", bsd)))
    texts += [(k, t + end) for k, t in texts if k == "Unlicense" for end in ("\nFor more information, please refer to " + u for u in UNLICENSE_URLS)]
    texts += [(k, re.sub(r"(?m)^\d\. ", "* ", t)) for k, t in texts if k.startswith("BSD")]
    texts += [(k, t[: t.index(TERMS_END) + with_line * len(TERMS_END)]) for k, t in texts if TERMS_END in t for with_line in (0, 1)]
    # the line of the address below the copyright line of older texts
    texts += [(k, re.sub(r"(?m)^.*Franklin Street.*\n", "", t, count=1)) for k, t in texts if "Franklin Street" in t]
    texts += [(k, t) for k, t in KNOWN if k in ("MIT", "ISC", "0BSD") and len(t) > 200]
    return tuple(texts + [(k, f"{title}\n\n{t}") for k, t in texts for title in TITLES.get(k, ())])


def digest(text: Column) -> Column:
    """Digest of the canonical form; that of an empty form is no known digest."""
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: tuple = KNOWN) -> DataFrame:
    """license and digest of the known texts, one row per digest."""
    found = spark.createDataFrame(list(known), "license string, text string").select("license", digest(F.col("text")).alias("digest"))
    return found.where(F.col("digest") != F.sha2(F.lit(""), 256)).groupBy("digest").agg(F.min("license").alias("license"))


def shipped_digests(spark: SparkSession) -> DataFrame:
    """The digests of all shipped notices and texts, as a table of literals (the texts stay out of the plan)."""
    rows = known_digests(spark, KNOWN + entire_texts()).collect()
    pairs = F.array(*[F.struct(F.lit(r["license"]).alias("license"), F.lit(r["digest"]).alias("digest")) for r in rows])
    return spark.range(1).select(F.explode(pairs).alias("k")).select("k.license", "k.digest")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, whole_license, n_license_lines and licenses (sorted, distinct, of text and lines)."""
    if known is None:
        known = F.broadcast(shipped_digests(docs.sparkSession))  # a fixed list
    elif known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    # numbers rows, not documents: repeated rows stay apart
    d = docs.select("doc_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    unit = lambda text, whole: F.struct(digest(text).alias("digest"), F.lit(whole).alias("whole"))
    units = F.concat(F.array(unit(F.col("text"), True)), F.transform(F.split("text", "\n"), lambda x: unit(x, False)))
    u = d.select("row", "doc_id", F.explode(units).alias("u")).select("row", "doc_id", "u.digest", "u.whole")
    # the whole-text row of every document, and the lines that are known
    hit = u.join(known, "digest", "left").where(F.col("whole") | F.col("license").isNotNull())
    return hit.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        F.count(F.when(~F.col("whole"), F.col("license"))).alias("n_license_lines"),
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
    ).drop("row")


def oracle_sql(known: tuple = KNOWN) -> str:
    """The same result in DuckDB SQL over the table documents."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(of: str) -> str:
        out = (
            f"regexp_replace(lower({of}), "
            "'(?m)^[^\\p{L}\\p{N}\\n]*(copyright [^\\n]*|\\(c\\) [^\\n]*|©[^\\n]*|all rights reserved[^\\n]*)$', '', 'g')"
        )
        for other, one in SPELLINGS:
            out = f"replace({out}, {quoted(other)}, {quoted(one)})"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in known)
    return f"""WITH known AS (
  SELECT digest, min(license) AS license
  FROM (SELECT license, sha256({form('text')}) AS digest FROM (VALUES {values}) v(license, text))
  GROUP BY digest),
units AS (
  SELECT doc_id, coalesce(text, '') AS part, true AS whole FROM documents
  UNION ALL
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part, false AS whole FROM documents),
forms AS (SELECT doc_id, whole, {form('part')} AS form FROM units),
hits AS (
  SELECT f.doc_id, f.whole, k.license FROM forms f LEFT JOIN known k ON f.form <> '' AND sha256(f.form) = k.digest)
SELECT doc_id,
  max(CASE WHEN whole THEN license END) AS whole_license,
  count(CASE WHEN NOT whole THEN license END) AS n_license_lines,
  coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
FROM hits GROUP BY doc_id"""
