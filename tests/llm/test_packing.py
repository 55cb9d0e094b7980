import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rollscan.llm.packing import CapacityTree, Encoder, best_fit_plan, cut, pack_documents, sequences, tokenize_pieces
from rollscan.session import materialize

REFERENCE = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
ENCODER = Encoder()


def ids_of(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_agree_with_tokenizers(text):
    assert ENCODER.ids(text) == ids_of(text)


def test_strings_of_added_tokens_are_ids_of_their_own():
    slow = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for token in ENCODER.added:
        for text in (token, f"a{token}b", f" {token} {token}x", token[:-1], f"é{token}"):
            assert ENCODER.ids(text) == slow.encode(text, add_special_tokens=False).ids
    assert len(ENCODER.ids("a<|endoftext|>b")) == 3


def test_ids_of_awkward_texts(sample):
    texts = ["", " " * 5000, "\n" * 3000 + "x", "a" * 20_000, "  a  \t b\r\n\x0b", "　\xa0  x", "don't WE'LL it's", "é‍\U0001f468‍\U0001f469", "١٢٣ Ⅷ ½", "\x00\x1c\x85"]
    for t in texts + [r[0] for r in sample.select("text").collect()]:
        assert ENCODER.ids(t) == ids_of(t)


def best_fit(lengths, size):
    """Best-fit decreasing one piece at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(size - n)
    return sorted(left)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for size in (1, 7, 50, 64):
        for _ in range(60):
            lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
            used, free = defaultdict(int), Counter(lengths)
            for length, a, b, first, per_bin, at in best_fit_plan(Counter(lengths), size):
                for rank in range(a, b):
                    bin_, k = divmod(rank - a, per_bin)
                    assert used[first + bin_] == at + k * length
                    used[first + bin_] += length
                    free[length] -= 1
            assert not any(free.values()) and max(used.values(), default=0) <= size
            assert sorted(size - u for u in used.values()) == best_fit(lengths, size)


def test_tree():
    t = CapacityTree(100)
    for c in (3, 64, 100):
        t.set(c, True)
    assert [t.tightest(i) for i in (1, 3, 4, 64, 65, 100)] == [3, 3, 64, 64, 100, 100]
    t.set(100, False)
    assert t.tightest(65) is None and cut(1, 4) == [(0, 1)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and cut(8, 4) == [(0, 4), (4, 4)]


def check(df, rows, size):
    out = df.collect()
    want = Counter()
    for key, text in rows:
        ids = np.array(ids_of(text) + [0], "<u4")
        start = 0
        for i, (start, n) in enumerate(cut(len(ids), size)):
            want[(key, i, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    assert len(bins) == len(best_fit([k[3] for k in want.elements()], size))


def test_packing(docs, sample, no_docs):
    for d in (docs, sample):
        check(pack_documents(d), [tuple(r) for r in d.select("doc_id", "text").collect()], 2048)
    check(pack_documents(sample, seq_len=100), [tuple(r) for r in sample.select("doc_id", "text").collect()], 100)
    assert pack_documents(no_docs).count() == 0


def test_sequences_hold_the_ids(sample):
    few = sample.limit(30)
    packed = materialize(pack_documents(few, with_ids=True))
    seqs = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    for r in packed.collect():
        assert seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert tokenize_pieces(few).count() == packed.count()
