"""The classifier learns words in context, keeps held-out rows out, and scores any text."""

import copy
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from corpaudit.llm import toxicity


def _table():
    rng = random.Random(8)
    plain = [a + b for a in ("ka", "lo", "mi", "re", "su") for b in ("na", "to", "ve", "xi")]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        if toxic:
            for w in ("blarg", "snork"):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), "s"))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "ka lo"), (1002, "kana " * 40_000 + "blarg snork"), (1003, "  ")]
    return rows, labels


def test_learns_and_scores(spark, documents):
    rows, labels = _table()
    docs = documents(rows, "score")
    marked = spark.createDataFrame(labels + [(5000, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marked)
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 60
    assert sum((found[i].score >= 0.5) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert found[1000].score == found[1001].score == found[1003].score < 0.5 <= found[1002].score
    assert toxicity.toxicity_scores(docs, model).count() == len(rows)
    other = toxicity.train(docs.repartition(5), marked)
    assert np.array_equal(model.table, other.table) and model.thresholds == other.thresholds


def test_held_out_labels_change_nothing(spark, documents):
    rows, labels = _table()
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.train(documents(rows), spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert np.array_equal(a.table, b.table) and a.scale == b.scale


def test_without_labels_or_rows(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none) is None
    assert [(r.score, r.toxic) for r in toxicity.toxicity_scores(docs, None).collect()] == [(0.0, False)] * 2
    assert toxicity.toxicity_scores(documents([]), None).count() == 0


@pytest.mark.parametrize("width", [1, 2, 3])
def test_pooling_matches_a_plain_convolution(width):
    settings = toxicity.Settings(buckets=64, widths=(width,), epochs=0)
    model = toxicity.fitted([toxicity.word_rows(b"a b c", 64), toxicity.word_rows(b"d", 64)], [1, 0], settings)
    rows = toxicity.word_rows(b"a b c d e", 64)
    x = model._embedded(rows)
    pooled, _ = model._pooled(x, 5)
    padded = np.concatenate([x[:5], np.zeros((width, x.shape[1]))])
    plain = [max(0, max(float((padded[i:i + width] * model.kernels[0][f]).sum()) for i in range(5))) for f in range(settings.filters)]
    assert np.allclose(pooled, plain, atol=1e-4)


def test_all_labelled_rows_count_whole(spark, documents):
    """Texts of any length, dealt into many pieces, whatever the tables' partitioning."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(150):
        words = [rng.choice(("kana", "lote", "mixi", "suve")) for _ in range(3000)]
        if i % 3 == 0:
            words[1500:1500] = ["blarg", "snork"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    marked, settings = spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.Settings(piece_rows=30)
    model = toxicity.train(documents(rows), marked, settings=settings)
    other = toxicity.train(documents(rows).repartition(7), marked.repartition(4), settings=settings)
    assert np.array_equal(model.table, other.table) and model.thresholds == other.thresholds and model.scale == other.scale
    found = {r.doc_id: r.score for r in toxicity.toxicity_scores(documents(rows), model).collect()}
    assert all((found[i] >= 0.5) == bool(y) for i, y in labels)


def test_row_counts_and_thresholds_are_exact(spark):
    """Counts over all pieces, and thresholds, against plain computations."""
    rng, s = random.Random(4), toxicity.Settings(buckets=64)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6))), None, i % 2, i % 5 > 0) for i in range(90)]
    pieces = spark.createDataFrame(rows, "_text string, _lang string, _label int, _fits boolean").repartition(4)
    plain = np.zeros((2, 128), np.int64)
    for text, _, label, fits in rows:
        if fits:
            plain[label, np.unique(toxicity.word_rows(text.encode(), 64))] += 1
    assert np.array_equal(toxicity._row_counts(toxicity._packed(pieces), s), plain)
    scores = [(rng.choice(["en", "de", "x", None]), int(rng.random() < 0.6), round(rng.random(), 2)) for _ in range(400)]
    scores = [(a, int(y or v > 0.8), v) for a, y, v in scores] + [("few", 1, 0.9)]
    found = toxicity._thresholds(spark.createDataFrame(scores, "lang string, label int, score double"), s)
    for name in ("en", "de", "x", None):
        own = [(v, y) for a, y, v in scores if name is None or a == name]
        cuts = sorted({v for v, _ in own}, reverse=True)
        good = [c for c in cuts if np.mean([y for v, y in own if v >= c]) >= s.precision]
        below = [c for c in cuts if good and c < good[-1]]
        assert found[name] == pytest.approx(max((good[-1] + (below[0] if below else 0)) / 2, s.least_threshold) if good else 0.5)
    assert set(found) == {"en", "de", "x", None}


def test_steps_take_no_copy_of_the_tables():
    """Steps between two states and their sum give the later state; only rows that moved are taken out."""
    settings = toxicity.Settings(buckets=1 << 15)
    counts = np.zeros((2, 2 * settings.buckets), np.int64)
    before = toxicity._Training.begun(counts, np.array([3, 3]), settings)
    after, again = copy.deepcopy(before), copy.deepcopy(before)
    for i in range(20):
        after.step(toxicity.word_rows(f"w{i} w{i + 1} blarg".encode(), settings.buckets), i % 2)
    tracemalloc.start()
    places, steps = after.steps_from(before)
    again.move(places, steps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < len(places) < 200 and peak < after.model.table.nbytes
    assert np.array_equal(again.model.table, after.model.table) and np.array_equal(again.squares[0], after.squares[0])
    assert np.array_equal(again.model.weights, after.model.weights) and again.model.bias == after.model.bias
    assert all(np.array_equal(a, b) for a, b in zip(again.model.kernels, after.model.kernels))


def test_scaling_reads_few_files(spark, documents, monkeypatch):
    """The raw answers' files follow their number, not that of the pieces of texts; every calibration row is there."""
    rows, labels = _table()
    seen, plain = [], toxicity._scaled

    def scaled(raws):
        seen.append((raws.rdd.getNumPartitions(), raws.count()))
        return plain(raws)

    monkeypatch.setattr(toxicity, "_scaled", scaled)
    toxicity.train(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), settings=toxicity.Settings(piece_rows=40))
    assert seen == [(1, sum(zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in labels))]
