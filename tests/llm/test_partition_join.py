"""The set join against all pairs; signatures against the pigeonhole they rest on."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpaudit.llm import partition_join as pj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    n = min(width, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def _brute(rows, percent=90):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    smallest = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            smallest[find(i)] = min(smallest.get(find(i), name), name)
    return Counter((name, len(sets[i]), smallest.get(find(i)) if sets[i] else name) for i, (name, _) in enumerate(rows))


def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        place = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[place] = f"new{rng.randrange(9999)}"
        elif kind == 1:
            del words[place]
        else:
            words.insert(place, f"ins{rng.randrange(9999)}")
    return words


def _rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = [None, "", "  \n", "one", "One", "one two", "ONE TWO", "a b c", "a b c d", "Ä b", "ä b", "x " * 60_000]
    for length in (8, 12, 25, 60, 150, 400):
        for _ in range(3):
            base = [word() for _ in range(length)]
            for edits in (0, 0, 1, 1, 2, 3, 5, 8, 12):
                texts.append(" ".join(_edited(rng, base, min(edits, length // 8 + 1))))
        chain = [word() for _ in range(length)]
        for _ in range(12):
            chain = _edited(rng, chain, max(1, length // 80))
            texts.append(" ".join(chain))
    dense = [word() for _ in range(200)]
    texts += [" ".join(_edited(rng, dense, 1)) for _ in range(40)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [rows[3], rows[3], (None, rows[20][1]), (None, "only here with a null key"), (rows[30][0], rows[40][1])]


@pytest.mark.parametrize("block,percent", [(pj.BLOCK, 90), (5, 90), (pj.BLOCK, 75)])
def test_components(spark, documents, monkeypatch, block, percent):
    monkeypatch.setattr(pj, "BLOCK", block)
    rows = _rows()
    found = pj.similarity_components(documents(rows, "node"), percent=percent).collect()
    assert Counter(map(tuple, found)) == _brute(rows, percent)


def test_empty_table(spark, documents):
    assert pj.similarity_components(documents([])).count() == 0
    found = pj.similarity_components(documents([(3, None), (4, " ")])).collect()
    assert sorted(map(tuple, found)) == [(3, 0, 3), (4, 0, 4)]


@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 40), st.sampled_from([80, 90, 95]), st.sampled_from([1, 10**5, 10**10]), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_similar_sets_share_a_signature(common, only_x, only_y, percent, rows, seed):
    rng = np.random.default_rng(seed)
    all_elements = np.unique(rng.integers(1, 2**63, common + only_x + only_y, dtype=np.uint64))
    rng.shuffle(all_elements)
    x, y = np.sort(all_elements[:common + only_x]), np.sort(np.concatenate([all_elements[:common], all_elements[common + only_x:]]))
    if len(np.intersect1d(x, y)) * 100 < percent * len(np.union1d(x, y)) or np.array_equal(x, y):
        return
    schemes = [pj.allocated(i, low, high, rows, percent) for i, (low, high) in enumerate(pj.bands(percent, 400))]
    lows = [s.low for s in schemes]

    def used(n):
        own = schemes[np.searchsorted(lows, n, side="right") - 1]
        return [own] + ([schemes[own.number + 1]] if n * 100 >= percent * (own.high + 1) else [])

    a = {v for s in used(len(x)) for v in pj.signatures(x, s).tolist()}
    b = {v for s in used(len(y)) for v in pj.signatures(y, s).tolist()}
    assert a & b
    bits = used(len(x))[-1].bits
    odd = np.bitwise_count(pj._folded(pj.parity(x, bits), 64) ^ pj._folded(pj.parity(y, 4 * bits), 64)).sum()
    assert odd <= len(np.setxor1d(x, y))


def test_more_rows_buy_larger_segments():
    few, many = pj.allocated(1, 500, 600, 10**4, 90), pj.allocated(1, 500, 600, 10**11, 90)
    assert few.deletions == 0 and many.deletions > 0 and many.segments < few.segments


def test_filter_of_shared_signatures_does_not_fill_up(spark, documents, monkeypatch):
    monkeypatch.setattr(pj, "SIGNATURE_BITS", 1 << 10)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts)]
    docs = documents(rows)
    schemes, words = pj._schemes(docs, "text", 80)
    filled, _ = pj._shared_filter(docs, "text", 5, 80, schemes, words)
    assert len(filled) * 64 > 1 << 10
    assert sum(int(w).bit_count() for w in filled) < 0.3 * 64 * len(filled)
