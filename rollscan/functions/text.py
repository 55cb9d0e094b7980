"""Text functions as Catalyst expressions (N1, N5, strip, labels).

All of these are built-in Spark expressions, so they stay inside
whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------
# Characters deleted by the Bengali normaliser: visarga U+0983, danda U+0964,
# hasanta U+09CD and the ASCII space U+0020.
NORMALIZE_DELETE = "ঃ।্ "
# Label words of the record extractor.
NAME_LABEL = "নাম"
GUARDIAN_LABELS = ("পিতার নাম", "স্বামীর নাম")
# Colon after a label: ASCII colon or full-width colon U+FF1A.
LABEL_COLONS = ":："
# Longest captured field value, in code points.
MAX_FIELD_CHARS = 200
# Python's str.isspace() set, i.e. what str.strip() and str.split() use.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# ---------------------------------------------------------------------------

# The same set as a regex character class, written with \x{..} escapes so the
# one pattern text runs in Java regex (Spark) and RE2 (DuckDB oracle).
WS_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _reuse_for_names(fn):
    """Build the expression once per column name: a Column is an immutable,
    unresolved expression, and each new one costs many Python→JVM calls."""
    cached = functools.lru_cache(maxsize=256)(fn)

    @functools.wraps(fn)
    def wrapper(c):
        return cached(c) if isinstance(c, str) else fn(c)

    return wrapper


@_reuse_for_names
def py_strip(c) -> Column:
    """``str.strip()``: drop Python whitespace at both ends (``trim`` only drops U+0020)."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


@_reuse_for_names
def normalize_bn(c) -> Column:
    """Delete visarga, danda, hasanta and U+0020, then strip; null → ''."""
    return F.coalesce(py_strip(F.translate(_col(c), NORMALIZE_DELETE, "")), F.lit(""))


@_reuse_for_names
def has_inner_whitespace(c) -> Column:
    """True when a (stripped) string still holds whitespace, i.e. splits into >1 token."""
    return _col(c).rlike(WS_CLASS)


@_reuse_for_names
def py_split(c) -> Column:
    """``str.split()`` with no argument: tokens between runs of Python whitespace."""
    stripped = py_strip(c)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, WS_CLASS + "+", -1)
    )


@_reuse_for_names
def token_set_key(c) -> Column:
    """Sorted distinct tokens joined by one space (the token-set form of a string)."""
    return F.array_join(F.array_sort(F.array_distinct(py_split(c))), " ")


def name_pattern(strict: bool = False, label: str = NAME_LABEL) -> str:
    """Java pattern of the name field: label, colon, lazy 1..200 chars, line end.

    ``(?d)`` makes only ``\\n`` a line terminator for ``.`` and ``$`` and
    ``(?m)`` makes ``$`` match at every line end, as in Python ``re.MULTILINE``.
    ``strict`` anchors the label to a line start, so a guardian line is not
    read as a name line.
    """
    anchor = "^" if strict else ""
    return (
        f"(?dm){anchor}{re.escape(label)}{WS_CLASS}*[{LABEL_COLONS}]{WS_CLASS}*"
        f"(.{{1,{MAX_FIELD_CHARS}}}?)(?:\\n|$)"
    )


def guardian_pattern(labels: tuple[str, ...] = GUARDIAN_LABELS) -> str:
    """Java pattern of the guardian field; group 1 = relation label, group 2 = value."""
    labels = "|".join(map(re.escape, labels))
    return (
        f"(?dm)({labels}){WS_CLASS}*[{LABEL_COLONS}]{WS_CLASS}*"
        f"(.{{1,{MAX_FIELD_CHARS}}}?)(?:\\n|$)"
    )


def field_pattern(label: str = NAME_LABEL, guardians: tuple[str, ...] = GUARDIAN_LABELS) -> str:
    """Java pattern of any field, in text order: group 1 = label (a name label at a line start, or
    a guardian label), group 2 = value."""
    labels = "|".join((f"^{re.escape(label)}", *map(re.escape, guardians)))
    return f"(?dm)({labels}){WS_CLASS}*[{LABEL_COLONS}]{WS_CLASS}*(.{{1,{MAX_FIELD_CHARS}}}?)(?:\\n|$)"


@_reuse_for_names
def basename(c) -> Column:
    """Last path segment (the reference's result ``file``)."""
    return F.element_at(F.split(_col(c), "/", -1), -1)
