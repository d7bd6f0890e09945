"""The Merkle manifest, phrase mining and passage attention against plain computations and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpaudit.llm import merkle, passages, phrases
from corpaudit.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(fields):
    return _h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _levels(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def _way(levels, place):
    """The runs above a leaf and its place in each."""
    for level in levels[:-1]:
        run = place // 16
        yield level[16 * run:16 * run + 16], place % 16
        place = run


def _plain_manifest(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append((-1 if row[0] is None else row[0], _leaf(row), row))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([leaf for _, leaf, _ in sorted(by_source[s], key=lambda x: x[:2])]) for s in order}
    top = _levels([trees[s][-1][0] for s in order])
    found = Counter()
    for at, s in enumerate(order):
        for place, (_, leaf, row) in enumerate(sorted(by_source[s], key=lambda x: x[:2])):
            way = [*_way(trees[s], place), *_way(top, at)]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = _leaf([*row[:4], row[4] and row[4].translate(LOWER)]) if changed else leaf
            for run, slot in way:
                node = _h(*run[:slot], node, *run[slot + 1:])
            others = [h for run, slot in way for i, h in enumerate(run) if i != slot]
            found[(row[0], leaf, trees[s][-1][0], top[-1][0], _h(*others), node, node == top[-1][0])] += 1
    return found


def _folded(docs):
    made = merkle.manifest(
        docs, COLUMNS, changes={"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")},
        changed=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
    )
    return made, made.folded()


def test_manifest_matches_plain_trees(documents):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("aBcÄ \n") for _ in range(rng.randrange(9))), "en", rng.choice(["a", "a", "a", "ü", "b"])) for i in range(700)]
    rows += [(900, "Alone", None, "z"), (901, None, "en", None), (None, "No key", "en", "a"), (7, "Same Key", "en", "a"), rows[3], rows[3], (902, "Long " * 40_000)]
    docs = documents(rows, extra="tree").withColumn("digest", F.lit("clash")).withColumn("position", F.lit(1))
    made, folded = _folded(docs)
    got = Counter(tuple(r) for r in folded.collect())
    plain = [tuple(r[c] for c in COLUMNS) for r in docs.collect()]
    assert got == _plain_manifest(plain)
    assert made.root().collect()[0]["root"] == next(iter(got))[3]
    assert not all(row[-1] for row in got) and any(row[-1] for row in got)


def test_manifest_of_few_rows(documents):
    _, one = _folded(documents([(11, "Only")]))
    got = one.collect()[0]
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    _, none = _folded(documents([(11, "x")]).limit(0))
    assert none.collect() == []


@settings(max_examples=20, deadline=None)
@given(st.lists(st.binary(min_size=32, max_size=32), min_size=2, max_size=16), st.integers(0, 15), st.binary(min_size=32, max_size=32))
def test_folding_resumes_at_the_midstate(children, place, new):
    place %= len(children)
    matrix = np.zeros((1, 16, 32), np.uint8)
    for i, child in enumerate(children):
        matrix[0, i] = np.frombuffer(child, np.uint8)
    sizes = np.array([len(children)])
    digest, states = merkle.nodes_over(matrix, sizes)
    assert digest[0].tobytes() == hashlib.sha256("".join(c.hex() for c in children).encode()).digest()
    hidden = matrix.copy()
    hidden[0, :place] = 99  # siblings on the left are in the state
    folded = merkle.refolded(np.frombuffer(new, np.uint8)[None], np.array([place]), sizes, states[:, place], hidden, np.array([0]))
    want = [*children[:place], new, *children[place + 1:]]
    assert folded[0].tobytes() == hashlib.sha256("".join(c.hex() for c in want).encode()).digest()


def _plain_phrases(rows, support, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang or "und"][tuple(words[i:i + n])] += 1
    found = []
    for lang, own in counts.items():
        kept = {p: f for p, f in own.items() if f >= support}
        inner = {p[i:i + n] for p, f in kept.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if f >= kept[p[i:i + n]]}
        rated = []
        for p, a in kept.items():
            if len(p) > 1 and p not in inner:
                score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        found += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rated)[:top])]
    return sorted(found)


@pytest.mark.parametrize("support, longest, top", [(6, 5, 2000), (3, 3, 10), (20, 2, 2000)])
def test_phrases_match_plain_counts(documents, support, longest, top):
    rng = random.Random(8)
    words = ["Der", "die", "das", "ÄH", "a", "b", "c\x1cd", "e f", "g"]
    mark = lambda: rng.choice([" ", " ", " ", "\t", ", ", ".", "\n"])
    rows = [(i, "".join(rng.choice(words) + mark() for _ in range(rng.randrange(60))), rng.choice(["de", "de", "de", "fr", None])) for i in range(150)]
    rows += [(200, None, "de"), (201, "", "fr"), (202, " \t.\n", "xx"), (203, "a " * 3000, "de"), (203, "a " * 30, "de")]
    got = phrases.collocations(documents(rows, extra="phrase"), support=support, longest=longest, top=top).collect()
    assert sorted(map(tuple, got)) == _plain_phrases([(r[1], r[2]) for r in rows], support, longest, top)


def test_phrases_of_nothing(documents):
    assert phrases.collocations(documents([(1, "a b")]).limit(0)).collect() == []
    assert phrases.collocations(documents([(1, "a b"), (2, None)])).collect() == []


def test_runs_of_any_length_find_the_same(documents, monkeypatch):
    monkeypatch.setattr(phrases, "RUN_WORDS", 50)
    rows = [(i, "x y z " * (i % 7), "en") for i in range(60)]
    found, _ = phrases.frequent_phrases(documents(rows), Scratch(), support=40, longest=4)
    want = Counter()
    for _, text, _ in rows:
        words = text.split()
        want.update(" ".join(words[i:i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    assert {r["phrase"]: r["f"] for r in found.collect()} == {p: f for p, f in want.items() if f >= 40}


def _noisy(rng, bad):
    words = [rng.choice(["stone", "river", "walks", "Green", "the", "of", "and", "house"]) for _ in range(rng.randrange(60, 400))]
    if bad:  # one stretch in the middle is a menu
        at = rng.randrange(len(words))
        words[at:at] = [w for _ in range(60) for w in (rng.choice(["Home", "Login", "About"]), "|")]
    return " ".join(words) + "."


def test_attention_learns_the_bad_passage(spark, documents):
    rng = random.Random(3)
    labels = [(i, int(rng.random() < 0.6)) for i in range(400)]
    rows = [(i, _noisy(rng, not good)) for i, good in labels]
    docs = documents(rows, extra="label").withColumn("id", F.lit("clash")).withColumn("quality", F.lit(5)).withColumn("score", F.lit(0))
    known = spark.createDataFrame(labels + [(5, None), (9999, 1)], "doc_id long, quality int")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = passages.train(docs, known, learn=part != 1)
    odd = documents([(5000, None), (5001, ""), (5002, " \n"), (5003, "word " * 50_000), (5003, "word " * 50_000), (None, "no key")])
    got = {r["doc_id"]: r for r in passages.quality_scores(docs, model, keep=["quality"]).collect()}
    held = [(i, good) for i, good in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i]["score"] >= 0.5) == bool(good) for i, good in held]) > 0.95
    assert all(got[i]["quality"] == 5 for i, _ in held)
    rest = passages.quality_scores(odd, model).collect()
    assert len(rest) == 6 and all(0 <= r["score"] <= 1 for r in rest)
    assert {r["n_passages"] for r in rest if r["doc_id"] in (5000, 5001, 5002)} == {1}
    assert passages.quality_scores(odd.limit(0), model).collect() == []
    only_one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert passages.train(docs, only_one, learn=F.lit(True)) is None
    assert {r["score"] for r in passages.quality_scores(odd, None).collect()} == {1.0}


def test_attention_gradients_match_differences():
    rng = np.random.default_rng(2)
    s = passages.Settings(epochs=1)
    vectors = [rng.normal(size=(n, passages._PLAIN + s.buckets)) for n in (1, 3, 7)]
    model = passages.fitted(vectors, [0, 1, 1], [1.0, 1.0, 1.0], s)
    x = model.prepared(vectors[2])

    def loss():
        logit = model.forward(x)[-1]
        return np.log1p(np.exp(-logit))

    for name, gradient in model.gradients(x, 1, 1.0).items():
        part = model.parts[name]
        for at in [tuple(rng.integers(0, n) for n in part.shape) for _ in range(4)]:
            kept, step = part[at], 1e-5
            part[at] = kept + step
            high = loss()
            part[at] = kept - step
            low = loss()
            part[at] = kept
            assert abs((high - low) / (2 * step) - gradient[at]) < 1e-5
