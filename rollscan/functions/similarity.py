"""Similarity scoring (N2, N3, N4, F10, F11) and lossless candidate bounds.

Scores follow the normalised Indel similarity: for strings ``a`` and ``b``
with ``L = len(a) + len(b)`` and longest common subsequence ``LCS``,
``ratio = 100 * 2 * LCS / L`` (both empty → 100).  A threshold test
``ratio >= t`` is done exactly in integers as ``200 * LCS >= t * L``.

The expressions are native: the LCS is bit-parallel (Hyyrö 2004) over
``bigint`` words of 62 positions, a fold over the characters of one string.
``lcs_of_block`` is the same for one string against a block of strings at once,
for tasks that hold both as Arrow columns.
Sketches of a string, three ``bigint`` of character and bigram counts, bound
the Indel distance of two strings from below by a popcount.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rollscan.functions.text import py_split

# Positions of a word of the bit-parallel LCS: sums of two words stay below the sign bit.
WORD_BITS = 62
FULL_WORD = (1 << WORD_BITS) - 1


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(value: int | Column) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("long")


def _shift_left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits.cast("int"))


# ---------------------------------------------------------------------------
# LCS
# ---------------------------------------------------------------------------
def _chars(text: Column) -> Column:
    """The characters of a text as an array; of an empty one none."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _masks(chars: Column, first: Column) -> Column:
    """Map of character to the bits of its places among ``chars[first:first + 62]``."""
    part = F.slice(chars, first + 1, F.lit(WORD_BITS))
    numbered = F.transform(part, lambda c, i: F.named_struct(F.lit("c"), c, F.lit("bit"), _shift_left(_long(1), i)))
    distinct = F.array_distinct(part)

    def mask(c: Column) -> Column:
        bits = F.filter(numbered, lambda e: e["c"] == c)
        return F.aggregate(bits, _long(0), lambda m, e: m.bitwiseOR(e["bit"]))

    return F.map_from_arrays(distinct, F.transform(distinct, mask))


def _advance(v: Column, mask: Column, carry: Column) -> Column:
    """The word before it is cut to its bits: (v + (v & mask) + carry) | (v & ~mask)."""
    used = v.bitwiseAND(mask)
    return (v + used + carry).bitwiseOR(v - used)


def _lcs_one_word(a: Column, b: Column) -> Column:
    """LCS length, characters of ``a`` (at most 62) as the bits of one word."""
    n = F.size(a)
    full = _shift_left(_long(1), n) - 1
    at = lambda masks, c: F.coalesce(F.try_element_at(masks, c), _long(0))
    return let(_masks(a, F.lit(0)), lambda masks: n - F.bit_count(
        F.aggregate(b, full, lambda v, c: _advance(v, at(masks, c), _long(0)).bitwiseAND(full))
    ))


def lcs_masks(text: Column) -> Column:
    """What ``lcs_by_masks`` needs of a string of 1 to 62 characters: its places by character; null for others."""
    return F.when(F.length(text).between(1, WORD_BITS), let(_chars(text), lambda c: _masks(c, F.lit(0))))


def lcs_by_masks(masks: Column, n: Column, text: Column) -> Column:
    """LCS length of a text and the string of n characters that the masks are of."""
    full = _shift_left(_long(1), n) - 1
    used = F.aggregate(
        F.split(text, ""), full, lambda v, c: _advance(v, F.coalesce(F.try_element_at(masks, c), _long(0)), _long(0)).bitwiseAND(full)
    )
    return (n - F.bit_count(used)).cast("int")


def _lcs_words(a: Column, b: Column) -> Column:
    """LCS length for any length of ``a``: as many words as it takes, the carry goes from word to word."""
    n = F.size(a)
    starts = F.sequence(F.lit(0), n - 1, F.lit(WORD_BITS))
    full = F.transform(starts, lambda s: F.when(n - s >= WORD_BITS, _long(FULL_WORD)).otherwise(_shift_left(_long(1), F.least(n - s, F.lit(WORD_BITS - 1))) - 1))
    at = lambda masks, c: F.coalesce(F.try_element_at(masks, c), _long(0))

    def over(masks: Column) -> Column:
        def step(v: Column, c: Column) -> Column:
            start = F.named_struct(F.lit("words"), F.array().cast("array<bigint>"), F.lit("carry"), _long(0))
            one = lambda s, k: let(
                _advance(F.get(v, k), at(F.get(masks, k), c), s["carry"]),
                lambda x: F.named_struct(
                    F.lit("words"), F.concat(s["words"], F.array(x.bitwiseAND(F.get(full, k)))),
                    F.lit("carry"), F.shiftrightunsigned(x, WORD_BITS).bitwiseAND(_long(1)),
                ),
            )
            places = F.sequence(F.lit(0), F.size(full) - 1)
            return F.aggregate(places, start, one, lambda s: s["words"])

        left = F.aggregate(b, full, step)
        return n - F.aggregate(left, F.lit(0), lambda total, w: total + F.bit_count(w))

    return let(F.transform(starts, lambda s: _masks(a, s)), over)


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings."""

    def of(pair: Column) -> Column:
        short, long = pair["short"], pair["long"]
        found = F.when(F.size(short) <= WORD_BITS, _lcs_one_word(short, long)).otherwise(_lcs_words(short, long))
        return F.when((F.size(short) == 0) | (F.size(long) == 0), F.lit(0)).otherwise(found).cast("int")

    first = F.length(a) <= F.length(b)
    short, long = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    return let(F.named_struct(F.lit("short"), _chars(short), F.lit("long"), _chars(long)), of)


def lcs_of_many(a: str, others: Iterable[str]) -> Iterator[int]:
    """The same length of one string with each of others, in Python: for lookups inside a task (``operators.boxes``)."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    for b in others:
        v = full
        for ch in b:
            used = v & masks.get(ch, 0)
            v = ((v + used) | (v - used)) & full
        yield len(a) - v.bit_count()


# Depth up to which ``lcs_of_block`` keeps the states of a string's prefixes.
KEPT_DEPTH = 32


def lcs_of_block(strings: list[str], block: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(place of a string, for every string of a block its characters outside their LCS), in the order of the strings.

    Strings up to 64 characters take one word of the smallest type that holds
    them, longer ones words of 62 places with a carry.  A string goes on from
    the state behind the prefix that it shares with the string before it.
    """
    lengths = np.array([len(s) for s in block], np.int64)
    longest = int(lengths.max(initial=0))
    kind = next((k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if longest <= 8 * k().itemsize), np.uint64)
    bits = 8 * kind().itemsize if longest <= 64 else WORD_BITS
    words = max(1, -(-longest // bits))
    # every character of the block: its string, its place there; by character
    codes = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(block)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(codes, kind="stable")
    found, starts = np.unique(codes[order], return_index=True)
    spans = dict(zip(found.tolist(), zip(starts.tolist(), [*starts.tolist()[1:], len(codes)])))
    masks: dict[str, np.ndarray | None] = {}

    def mask(c: str) -> np.ndarray | None:
        if c not in masks:
            masks[c] = None
            if ord(c) in spans:
                at = order[slice(*spans[ord(c)])]
                m = np.zeros((words, len(block)), kind)
                np.bitwise_or.at(m, (place[at] // bits, owner[at]), np.left_shift(kind(1), (place[at] % bits).astype(kind)))
                masks[c] = m
        return masks[c]

    used = np.clip(lengths - bits * np.arange(words)[:, None], 0, bits)
    top = np.uint64(64) - used.astype(np.uint64).clip(1)
    full = np.where(used > 0, np.uint64((1 << 64) - 1) >> top, np.uint64(0)).astype(kind)
    held = [np.empty_like(full) for _ in range(KEPT_DEPTH + 2)]
    both, total = np.empty(len(block), kind), np.empty(len(block), kind)

    def step(v: np.ndarray, m: np.ndarray, out: np.ndarray) -> None:
        """out = (v + (v & m) + carry) | (v & ~m)"""
        carry = None
        for w in range(words):
            np.bitwise_and(v[w], m[w], out=both)
            np.add(v[w], both, out=total)
            if carry is not None:
                np.add(total, carry, out=total)
            np.subtract(v[w], both, out=both)
            np.bitwise_or(total, both, out=out[w])
            if words > 1:
                carry = total >> np.uint64(WORD_BITS)
                np.bitwise_and(out[w], np.uint64(FULL_WORD), out=out[w])

    states, before = [full], ""
    for i in sorted(range(len(strings)), key=strings.__getitem__):
        s = strings[i]
        shared, most = 0, min(len(s), len(before), len(states) - 1)
        while shared < most and s[shared] == before[shared]:
            shared += 1
        del states[shared + 1 :]
        v = states[shared]
        for depth in range(shared, len(s)):
            m = mask(s[depth])
            if m is not None:
                # beyond the kept depth two states take turns
                out = held[depth] if depth < KEPT_DEPTH else held[KEPT_DEPTH + (v is held[KEPT_DEPTH])]
                step(v, m, out)
                v = out
            if depth < KEPT_DEPTH:
                states.append(v)
        before = s
        left = np.bitwise_count(v & full)
        yield i, left[0] if words == 1 else left.sum(axis=0, dtype=np.int64)


# ---------------------------------------------------------------------------
# Scores
# ---------------------------------------------------------------------------
def _share(dist: Column, total: Column) -> Column:
    return F.when(total > 0, F.lit(100.0) - F.lit(100) * dist / total).otherwise(F.lit(100.0))


def indel_ratio(a: Column, b: Column) -> Column:
    """Normalised Indel similarity in 0..100 (both empty → 100)."""
    total = F.length(a) + F.length(b)
    return _share(total - F.lit(2) * lcs(a, b), total)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Token-set similarity of two (already normalised) strings.

    Tokens are ``str.split()`` tokens.  Equal token sets, or one set inside the
    other with a common token, score 100; otherwise the best of the Indel
    ratio between the sorted leftover tokens and the two "intersection +
    leftover" comparisons.
    """
    tokens = lambda s: F.array_distinct(py_split(s))
    joined = lambda x: F.array_join(F.array_sort(x), " ")

    def parts(t: Column) -> Column:
        both = F.array_intersect(t["a"], t["b"])
        sides = [F.lit("x"), joined(F.array_except(t["a"], t["b"])), F.lit("y"), joined(F.array_except(t["b"], t["a"]))]
        none = (F.size(t["a"]) == 0) | (F.size(t["b"]) == 0)
        return F.named_struct(*sides, F.lit("both"), F.length(joined(both)), F.lit("none"), none)

    def score(p: Column) -> Column:
        x, y, sect = F.length(p["x"]), F.length(p["y"]), p["both"]
        glue = F.when(sect > 0, 1).otherwise(0)
        la, lb = sect + glue + x, sect + glue + y
        best = _share(x + y - F.lit(2) * lcs(p["x"], p["y"]), la + lb)
        shared = F.greatest(best, _share(glue + x, sect + la), _share(glue + y, sect + lb))
        inside = (sect > 0) & ((x == 0) | (y == 0))
        return F.when(p["none"], F.lit(0.0)).when(inside, F.lit(100.0)).when(sect == 0, best).otherwise(shared)

    # tokens without an inner blank on either side are the strings themselves
    pair = F.named_struct(F.lit("a"), tokens(a), F.lit("b"), tokens(b))
    return F.when((a == b) & (a != ""), F.lit(100.0)).otherwise(let(pair, lambda t: let(parts(t), score)))


# ---------------------------------------------------------------------------
# Sketches
# ---------------------------------------------------------------------------
# Characters are counted in 2 x 16 classes, up to four of each; bigrams are marked in 64 classes.
SKETCH = "struct<low:bigint,high:bigint,grams:bigint>"


def _counted(chars: Column, half: int) -> Column:
    """Unary counts up to four of the characters whose class lies in this half, 16 classes of four bits."""

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        at = F.pmod(code, F.lit(16)) * 4
        counted = F.call_function("shiftrightunsigned", acc, at.cast("int"))
        unary = counted.bitwiseAND(_long(7)) * 2 + 1
        mine = F.pmod(F.floor(code / 16), F.lit(2)) == half
        return F.when(mine, acc.bitwiseOR(_shift_left(unary, at))).otherwise(acc)

    return F.aggregate(chars, _long(0), add)


def sketch(text: Column) -> Column:
    """Counts of a string for ``sketch_distance``."""

    def of(c: Column) -> Column:
        pairs = F.transform(c, lambda x, i: F.concat(x, F.coalesce(F.get(c, i + 1), F.lit(""))))
        marks = F.transform(F.slice(pairs, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), lambda g: _shift_left(_long(1), F.pmod(F.xxhash64(g), F.lit(64))))
        grams = F.aggregate(marks, _long(0), lambda acc, m: acc.bitwiseOR(m))
        return F.named_struct(F.lit("low"), _counted(c, 0), F.lit("high"), _counted(c, 1), F.lit("grams"), grams)

    return let(_chars(text), of)


def sketch_within(a: Column, b: Column, budget: Column) -> Column:
    """Native pre-filter: false only if the Indel distance exceeds the budget.

    One insertion or deletion changes one character count and at most three
    bigrams.
    """
    apart = lambda f: F.bit_count(a[f].bitwiseXOR(b[f]))
    return (apart("low") + apart("high") <= budget) & (apart("grams") <= budget * 3)


# ---------------------------------------------------------------------------
# Native expressions
# ---------------------------------------------------------------------------
def ratio_at_least(lcs: Column, len_a: Column, len_b: Column, threshold: int) -> Column:
    """F10/F11 exactly: ``ratio >= t`` ⇔ ``200·LCS >= t·L`` (both empty → 100)."""
    total = len_a + len_b
    return (F.lit(200) * lcs >= F.lit(int(threshold)) * total) | (total == 0)


def ratio_score(lcs: Column, len_a: Column, len_b: Column) -> Column:
    """Indel ratio as a double, equal for equal rationals (used for arg-max)."""
    total = len_a + len_b
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs / total)


def length_window(len_b: Column, threshold: int) -> tuple[Column, Column]:
    """Lengths of ``a`` that can reach ``t`` against a string of length ``len_b``.

    Since LCS <= min(len), ``200·min(la, lb) >= t·(la + lb)`` must hold, i.e.
    ``la`` in ``[ceil(t·lb / (200 − t)), floor((200 − t)·lb / t)]``.  Integer
    arithmetic only.  Requires ``0 < t <= 100``.
    """
    t = int(threshold)
    lo = F.floor((F.lit(t) * len_b + F.lit(199 - t)) / F.lit(200 - t)).cast("int")
    hi = F.floor((F.lit(200 - t) * len_b) / F.lit(t)).cast("int")
    return lo, hi


def indel_budget(len_a: Column, len_b: Column, threshold: int) -> Column:
    """Largest Indel distance that still reaches ``t``: ``floor((100 − t)·L / 100)``."""
    total = len_a + len_b
    return F.floor(F.lit(100 - int(threshold)) * total / F.lit(100)).cast("int")


def levenshtein_within(a: Column, b: Column, budget: Column) -> Column:
    """Native pre-filter: Levenshtein <= Indel, so ``lev > budget`` rules a pair out."""
    return F.call_function("levenshtein", a, b, budget) >= 0
