"""Benchmark spans against a brute-force search for every window."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

import numpy as np

from corpaudit.llm import common, winnowing
from corpaudit.llm.common import plain_words

LONG = "lorem " * 40_000


def _brute(docs, items):
    rows = []
    for name, text in docs:
        words, hit, found = plain_words((text or "").encode()), set(), set()
        for item, content in items:
            other = plain_words((content or "").encode())
            n = min(13, len(other))
            wanted = {tuple(other[i:i + n]) for i in range(len(other) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found.add("" if item is None else str(item))
        rows.append((name, len(words), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(words)))
    return Counter(rows)


def _cases():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz")
    run = lambda n: [word() for _ in range(n)]
    items = [(i, run(rng.randrange(13, 40))) for i in range(12)] + [(20, run(3)), (21, run(12)), (22, ["aa"] * 30), (23, ["aa"] * 13), (24, []), (25, ["one"])]
    items.append((26, items[0][1]))
    items.append((None, items[1][1]))
    docs = [(0, None), (1, ""), (2, "!!! ??"), (3, "aa " * 50), (4, "aa " * 12), (None, "aa " * 13), (5, "One"), (6, LONG + " ".join(items[2][1]) + " " + LONG)]
    for i in range(100, 190):
        words = run(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            _, other = rng.choice(items)
            a = rng.randrange(max(1, len(other)))
            words[rng.randrange(len(words) + 1):0] = other[a:a + rng.randrange(5, 30)]
        docs.append((i, ", ".join(words).upper() if i % 2 else " ".join(words)))
    docs += [docs[-1], docs[-1]]
    return docs, [(i, " ".join(w)) for i, w in items]


@pytest.mark.parametrize("bits", [winnowing.FILTER_BITS, 1 << 12])
def test_contamination(spark, documents, monkeypatch, bits):
    monkeypatch.setattr(winnowing, "FILTER_BITS", bits)  # a nearly full filter changes nothing
    docs, items = _cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n_words", "2 AS row")
    found = winnowing.contamination(documents(docs, "row"), benchmark).collect()
    assert Counter((r[0], r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found) == _brute(docs, items)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    found = winnowing.contamination(documents([(1, "a b c"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in found) == [(1, 3, 0, False), (2, 0, 0, False)]
    assert winnowing.contamination(documents([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


@given(st.lists(st.integers(0, 3), max_size=50), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_every_window_keeps_its_leftmost_least(ids, width):
    hashes = common.mixed_bits(np.array(ids, np.uint64) + np.uint64(1))
    top = [int(h) >> common.PLACE_BITS for h in hashes]
    wanted = {min(range(j, j + width), key=lambda i: (top[i], i)) for j in range(len(ids) - width + 1)}
    assert common.winnowed(hashes, width).tolist() == sorted(wanted)
