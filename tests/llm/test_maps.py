"""License templates, quality rules and token counts: maps over texts, against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpaudit.llm import divergence, licenses, tokencounts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "MIT License"), (4, "MIT License"), (None, "an Apache License, here"), (5, "é" * 50_000),
    (6, ("word " * 30_000) + "MIT license"),
]


@pytest.mark.parametrize("text,accepted", [
    ("Released under the MIT License.", {"MIT"}),
    ("x This fine work is released under the terms of the MIT License y", {"MIT"}),
    ("Released under an MIT License.", set()),
    ("Licensed under the Apache License, Version 2.0 (the License)", {"Apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"GPL-notice"}),
    ("licensed under CC BY 4.0", {"CC-BY"}),
    ("my tool is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation", {"GPL-text"}),
])
def test_templates_accept_exact_mandatory_wording(text, accepted):
    words = licenses.plain_words(text.encode())
    spaced = b" " + b" ".join(words) + b" "
    found = {
        label for label, template in licenses.TEMPLATES.items()
        if licenses._template_matches(licenses.compiled(label, template), words, spaced)[0]
    }
    assert found == accepted


@pytest.mark.parametrize("bad", ["<<optional>>a", "a<</optional>>", "<<optional>>a<</optional>>"])
def test_bad_templates_raise(bad):
    with pytest.raises(ValueError):
        licenses.compiled("x", bad)


def _brute_phrases(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(label, i, i + len(p) - 1) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), sorted(places)


def test_license_places(spark, documents):
    rng = random.Random(3)
    pool = ["MIT", "license", "Apache", "cc", "by", "gnu", "general", "public", "x", "é"]
    rows = EDGES + [(10 + i, " ".join(rng.choice(pool) for _ in range(40))) for i in range(60)]
    found = licenses.scan_licenses(documents(rows)).collect()
    got = Counter((r.doc_id, r.n_words, tuple(sorted((p.label, p.first, p.last) for p in r.phrase_places))) for r in found)
    assert got == Counter((i, n, tuple(p)) for i, t in rows for n, p in [_brute_phrases(t)])
    assert all(0 <= r.score <= 1 for r in found)
    assert licenses.scan_licenses(documents([])).count() == 0


def _brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(5)}
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered), failed


def test_quality_counts(spark, documents):
    rng = random.Random(5)
    rows = EDGES + [
        (20 + i, "".join(rng.choice(["the ", "a ", "b\n", "ü ", "# ", "\n", "c d ", "<x> "]) for _ in range(rng.randrange(120))), rng.choice(["en", "xx", None]))
        for i in range(80)
    ]
    found = divergence.quality_rules(documents(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in found) == Counter((row[0], *_brute_quality(row[1])) for row in rows)
    assert not any(r.kept and r.base_failed for r in found)
    assert divergence.quality_rules(documents([])).count() == 0


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_repeated_words(ids, width):
    words = [b"%d" % i for i in ids]
    windows = Counter(tuple(words[i:i + width]) for i in range(len(words) - width + 1))
    covered = {i + j for i in range(len(words) - width + 1) if windows[tuple(words[i:i + width])] > 1 for j in range(width)}
    assert divergence.repeated_words(words, width) == len(covered)


def test_other_language_is_far_from_its_reference(spark, documents):
    rng = random.Random(1)
    english = ["the", "of", "and", "to", "in", "is", "it", "house", "river", "stone", "bread", "light"]
    german = ["der", "die", "und", "in", "den", "von", "zu", "haus", "fluss", "stein", "brot", "licht"]
    rows = [(i, " ".join(rng.choice(english) for _ in range(300)), "en") for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice(german) for _ in range(300)), "de") for i in range(40)]
    rows += [(200, " ".join(rng.choice(german) for _ in range(300)), "en"), (201, "x#%$ " * 3, "en")]
    kept = {r.doc_id: r for r in divergence.quality_rules(documents(rows)).collect()}
    far = kept[200]
    assert far.word_distance > 2 * max(kept[i].word_distance for i in (0, 1, 2, 100, 101))
    assert kept[201].word_distance is None
    assert divergence.jensen_shannon(np.array([1., 0]), np.array([0, 1.])) == 1.0


CODER = tokencounts.encoder(tokencounts.RANKS, tokencounts.PATTERN)
PIECES = st.text(st.sampled_from(list("ab'st 1!\n\té中  ")), max_size=12)


@given(st.lists(PIECES, max_size=60), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 30), PIECES), max_size=5), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_edited_tree_equals_a_fresh_count(parts, edits, leaf):
    text, old = "".join(parts), tokencounts.LEAF
    tokencounts.LEAF = leaf
    try:
        tree = tokencounts.TokenTree(text, CODER)
        for start, length, new in edits:
            start = min(start, len(text))
            end = min(start + length, len(text))
            text = text[:start] + new + text[end:]
            tree.edit(start, end, new)
            assert tree.text() == text
            assert tree.total == len(CODER.encoding.encode_ordinary(text))
            assert tree.pieces == len(CODER.split(text))
    finally:
        tokencounts.LEAF = old


def test_edited_counts(spark, documents):
    long = "some words and a.b@example.com or 4785380592391139 again " * 400
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"), (4, "plain")]
    found = tokencounts.edited_counts(documents(rows, "n_tokens")).collect()
    for r in found:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        after = text
        for start, end, mask in reversed(tokencounts.mask_edits(text)):
            after = after[:start] + mask + after[end:]
        assert r.n_tokens == len(CODER.encoding.encode_ordinary(text))
        assert r.n_tokens_after == len(CODER.encoding.encode_ordinary(after)) == sum(r.leaf_tokens)
        assert sum(r.leaf_chars) == len(after)
    assert next(r for r in found if r.doc_id == 3).n_edits == 800
    assert tokencounts.edited_counts(documents([])).count() == 0


def test_edits_from_a_column(spark):
    df = spark.createDataFrame(
        [(1, "one two three", [(4, 7, "2"), (5, 9, "!")]), (2, "ab", None), (3, None, [(9, 9, "new")])],
        "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>",
    )
    found = {r.doc_id: r for r in tokencounts.edited_counts(df, edits="edits").collect()}
    count = lambda t: len(CODER.encoding.encode_ordinary(t))
    assert found[1].n_tokens_after == count("one 2!hree") and found[2].n_tokens_after == count("ab") and found[3].n_tokens_after == count("new")
