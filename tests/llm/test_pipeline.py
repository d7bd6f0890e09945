"""The corpus pipeline stage by stage against plain computations, and as a whole."""

import random
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corpaudit.llm import secrets
from .test_partition_join import _edited, _set
from .test_winnowing import _brute as brute_contamination


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    rng = random.Random(21)
    words = [a + b + c for a in "bdgkl" for b in "aeiou" for c in ("n", "st", "r", "mp")]
    run = lambda n: [rng.choice(words) for _ in range(n)]
    items = [run(rng.randrange(20, 40)) for _ in range(8)]
    rows, labels = [], []
    for i in range(420):
        text = run(rng.randrange(30, 150))
        toxic = i % 5 == 0
        if toxic:
            for bad in ("vlerk", "snotz", "grumf"):
                text.insert(rng.randrange(len(text)), bad)
        if i % 11 == 1:
            text[10:10] = rng.choice(items)
        if i % 13 == 2:
            text[5:5] = ["token", "=", f'"{rng.getrandbits(160):040x}"']
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", None])))
        labels.append((i, int(toxic)))
    for i in range(60):
        rows.append((1000 + i, " ".join(_edited(rng, rows[7 * (i % 9) + 2][1].split(), i % 4)), "en", "a"))
    rows += [(2000, None, "en", "a"), (2001, ""), (2001, ""), (None, "a few words with a null key"), rows[8], rows[8], (3000, "kan " * 30_000, "en", "b")]
    path = tmp_path_factory.mktemp("tables")
    documents(rows, None).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), labels


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(corpus_pipeline.written(stage(spark, found[-1], folder[0])))
    return found


def _rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_columns(stages):
    assert all(df.columns == ["doc_id", "text", "lang", "source", "n_chars"] for df in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(stages, folder):
    left = {r.doc_id for r in stages[1].collect()}
    toxic = {i for i, y in folder[1] if y}
    assert not toxic & left
    assert {i for i, y in folder[1] if not y} <= left and {2000, 2001, None, 3000} <= left
    assert stages[1].count() == sum(1 for r in stages[0].collect() if r.doc_id in left)


def test_one_of_each_group_stays(stages):
    before = sorted(_rows(stages[1]).elements(), key=str)
    sets = [_set(t, 5) for _, t in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, row in enumerate(before):
        groups[find(i) if sets[i] else ("none", row)].append(row)
    smallest = Counter(min(i for i, _ in rows) if all(i is not None for i, _ in rows) else min((i for i, _ in rows if i is not None), default=None) for rows in groups.values())
    assert len(groups) < len(before) - 20
    assert Counter(i for i, _ in _rows(stages[2]).elements()) == smallest
    assert not _rows(stages[2]) - _rows(stages[1])


def test_contaminated_documents_go(stages, folder, spark):
    items = [tuple(r) for r in spark.read.parquet(f"{folder[0]}/benchmark.parquet").collect()]
    before = list(_rows(stages[2]).elements())
    bad = {row[0] for row in brute_contamination(before, items) if row[4]}
    assert len(bad) > 10
    assert _rows(stages[3]) == Counter(row for row in before if row[0] not in bad)


def test_secrets_are_masked_and_nothing_else(stages):
    before, after = {r.doc_id: r for r in stages[3].collect()}, {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after) and stages[3].count() == stages[4].count()
    masked = [i for i in before if re.search(r'token = "[0-9a-f]{40}"', before[i].text or "")]
    assert len(masked) > 10
    for i, r in after.items():
        if i in masked:
            assert f'token = "{secrets.MASK}"' in r.text and r.n_chars == len(r.text)
        elif not re.search("[0-9a-f]{40}", before[i].text or ""):  # else a near copy may have lost the words around
            assert r == before[i]


def test_run_equals_its_stages(spark, stages, folder):
    whole = Counter(corpus_pipeline.run(spark, folder[0]).collect())
    assert whole == Counter(stages[-1].collect())
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert sum(r.taken for r in whole) == sum({r.source_rank: round(r.target) for r in whole}.values())


def test_empty_tables(spark, folder, documents):
    empty = documents([], None)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0
