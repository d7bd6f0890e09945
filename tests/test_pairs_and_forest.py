"""All pairs above a threshold and the spanning forest, against plain computations."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from corpaudit.operators import allpairs, components, forest, neighbours


def sparse_rows(seed, n):
    """Vectors over 60 terms: one term in nearly all of them, near copies, exact copies, and empty ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        vector = {t: rng.random() + 0.1 for t in rng.sample(range(1, 60), rng.randrange(1, 7))}
        if rng.random() < 0.9:
            vector[0] = rng.random()
        rows.append((i, vector))
    for i in range(80):
        vector = dict(rows[i % 5][1])
        vector[rng.randrange(60)] = 0.3 * rng.random() + 0.01
        rows.append((1000 + i, vector))
    rows += [(2000 + i, dict(rows[3][1])) for i in range(7)] + [(3000, {})]
    return rows


def brute(rows, threshold):
    matrix = np.zeros((len(rows), 60))
    for i, (_, vector) in enumerate(rows):
        for term, weight in vector.items():
            matrix[i, term] = weight
    norms = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(norms == 0, 1, norms)[:, None]
    return {
        (min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-9, 1)))
    }


def frame(spark, rows):
    entries = [(i, [(t, w) for t, w in vector.items()]) for i, vector in rows]
    return spark.createDataFrame(entries, "id long, entries array<struct<term:int,weight:double>>")


@pytest.mark.parametrize("threshold, block", [(0.8, 256), (0.5, 16), (0.95, 8)])
def test_all_pairs_match_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(allpairs, "BLOCK", block)
    rows = sparse_rows(3, 200)
    found = allpairs.pairs_above(frame(spark, rows), "id", F.col("entries"), threshold)
    rep = {r["id"]: r["rep"] for r in found.members.collect()}
    listed = [(r["row_a"], r["row_b"]) for r in found.pairs.collect()]
    assert len(listed) == len(set(listed))
    groups = {}
    for i, r in rep.items():
        groups.setdefault(r, []).append(i)
    spread = {(min(x, y), max(x, y)) for a, b in listed for x in groups[a] for y in groups[b]}
    spread |= {(x, y) for own in groups.values() for x in own for y in own if x < y}
    expected = brute(rows, threshold)
    assert spread == expected
    links = {r["id"]: r["links"] for r in found.links().collect()}
    assert links == {i: sum(i in pair for pair in expected) for i in rep}
    assert 3000 not in links


def test_all_pairs_of_nothing_and_of_dense_vectors(spark):
    empty = spark.createDataFrame([], "id long, entries array<struct<term:int,weight:double>>")
    assert allpairs.pairs_above(empty, "id", F.col("entries"), 0.5).pairs.count() == 0
    with pytest.raises(ValueError):
        allpairs.pairs_above(empty, "id", F.col("entries"), 0)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 0.0]), (5, None)], "id long, v array<double>")
    found = {(r["row_a"], r["row_b"]) for r in neighbours.knn_pairs(df, "id", "v", None, 0.9).collect()}
    assert found == {(1, 2), (1, 3)}


def test_few_comparisons_of_unrelated_vectors(spark):
    """Index entries join rows that share a rare term, not rows that share a frequent one."""
    rows = [(i, {0: 0.2, 1 + i % 50: 1.0, 60 + i: 2.0}) for i in range(400)]
    index = allpairs._indexed(frame(spark, rows).select("id", F.array_sort("entries").alias("entries")), 0.9)
    assert index.filter("term = 0").count() == 0


@pytest.mark.parametrize("rows_of_a_block", [16, 4096])
def test_sketches_find_the_pairs_that_the_index_finds(spark, monkeypatch, rows_of_a_block):
    """Few classes, so that sketches leave more open than there is; weights of both signs; ties at the threshold."""
    monkeypatch.setattr(allpairs, "SKETCH", 8)
    monkeypatch.setattr(allpairs, "ROWS", rows_of_a_block)
    rows = sparse_rows(7, 120) + [(4000, {1: 1.0, 2: -1.0}), (4001, {1: 1.0, 2: -0.9}), (4002, {1: 1.0, 2: 1.0})]
    ways = []
    for listed in (0, 10**9):
        monkeypatch.setattr(allpairs, "LISTED", listed)
        found = allpairs.pairs_above(frame(spark, rows), "id", F.col("entries"), 0.7).edges()
        ways.append({(r["row_a"], r["row_b"]): round(r["cosine_similarity"], 9) for r in found.collect()})
    assert ways[0] == ways[1]
    assert (4000, 4001) in ways[0] and (4000, 4002) not in ways[0]


def test_no_vector_is_sent_for_every_term(spark, monkeypatch):
    """Vectors that share many terms: the index would send each for all of its terms and blocks."""
    rng = np.random.default_rng(1)
    rows = [(i, {int(t): float(rng.random()) for t in rng.choice(60, 30, replace=False)}) for i in range(200)]

    def refused(index):
        raise AssertionError("the index is dealt out")

    monkeypatch.setattr(allpairs, "_dealt", refused)
    found = allpairs.pairs_above(frame(spark, rows), "id", F.col("entries"), 0.8)
    assert {(r["row_a"], r["row_b"]) for r in found.pairs.collect()} == brute(rows, 0.8)


def union_find(nodes, pairs, threshold):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b, s in pairs:
        if s >= threshold:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_one_forest_gives_all_thresholds(spark, kind):
    rng = random.Random(5)
    nodes = list(range(1, 61))
    if kind == "random":
        pairs = [(rng.choice(nodes), rng.choice(nodes), round(rng.random(), 2)) for _ in range(150)]  # ties, loops, repeats
    elif kind == "chain":
        pairs = [(n, n + 1, n / 100) for n in nodes[:-1]]
    else:
        pairs = [(60, n, rng.choice([0.2, 0.5, 0.9])) for n in nodes[:-1]]
    df = spark.createDataFrame(pairs, "row_a long, row_b long, cosine_similarity double")
    grown = forest.spanning_forest(df)
    tree = [(r["row_a"], r["row_b"], r["cosine_similarity"]) for r in grown.pairs().collect()]
    whole = union_find(nodes, pairs, 0)
    assert len(tree) == len(nodes) - len(set(whole.values()))
    assert {(min(a, b), max(a, b), s) for a, b, s in tree} <= {(min(a, b), max(a, b), s) for a, b, s in pairs}
    thresholds = [0.0, 0.1, 0.2, 0.33, 0.5, 0.51, 0.75, 0.9, 0.99]
    rows = spark.createDataFrame([(n,) for n in nodes], "id long")
    found = {}
    for r in grown.clusters_at(rows, "id", thresholds).collect():
        found.setdefault(r["similarity_threshold"], {})[r["id"]] = r["cluster"]
    assert found == {t: union_find(nodes, pairs, t) for t in thresholds}


def test_forest_of_nothing_keeps_singletons(spark):
    none = spark.createDataFrame([], "row_a long, row_b long, cosine_similarity double")
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    found = forest.spanning_forest(none).clusters_at(rows, "id", [0.5]).collect()
    assert sorted((r["id"], r["cluster"]) for r in found) == [(1, 1), (2, 2)]


def test_every_vector_is_shuffled_once_for_all_comparisons(spark, monkeypatch):
    """Blocks hold each point once, and meet without an exchange, however many cells a row's bound leaves open."""
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 20)
    rng = np.random.default_rng(7)
    points = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(90, 8)))],
                                   "id long, vector array<double>")
    _, met = neighbours._blocks(points, 90, 3, -1.0)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    blocks = {r["block"]: np.frombuffer(r["ids"], np.int64).tolist() for r in met.collect()}
    assert sorted(i for ids in blocks.values() for i in ids) == list(range(90)) and len(blocks) > 4


@pytest.mark.parametrize("chunk", [8192, 9])
def test_dense_pairs_match_brute_force_with_copies_and_short_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(11)
    vectors = np.vstack([rng.normal(size=(60, 5)), np.array([1.0, 2, 3, 4, 0]) + rng.normal(scale=0.05, size=(30, 5))])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(100, [1.0, 2.0, 3.0, 4.0]), (101, [2.0, 4.0, 6.0, 8.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = neighbours.dense_pairs_above(df, "id", "v", 0.6)
    full = np.array([[x or 0.0 for x in v] + [0.0] * (5 - len(v)) for _, v in rows if _ != 101])
    unit = full / np.linalg.norm(full, axis=1, keepdims=True)
    ids = [i for i, _ in rows if i != 101]
    expected = {(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.6, 1)))}
    listed = [(r["row_a"], r["row_b"]) for r in found.pairs.collect()]
    assert len(listed) == len(set(listed)) and set(listed) == expected
    assert {(r["id"], r["rep"]) for r in found.members.filter("copies > 1").collect()} == {(100, 100), (101, 100)}


def test_forest_keeps_rows_nodes(spark):
    """The trees aren't sent to every task of every pass; the fit is the same."""
    from corpaudit.operators import models

    rng = np.random.default_rng(2)
    rows = [(int(x + 0.3 * e > 0.5), DenseVector([x, y]), 1.0) for x, y, e in rng.random((120, 3)).tolist()]
    train = spark.createDataFrame(rows, ["label", "features", "weight"])
    estimator = models._estimator(models.ModelSpec("forest", models.FOREST, trees=5), 120.0, 7)
    assert estimator.getCacheNodeIds()
    plain = estimator.copy({estimator.cacheNodeIds: False})
    assert estimator.fit(train).toDebugString.split("\n")[1:] == plain.fit(train).toDebugString.split("\n")[1:]


@pytest.mark.parametrize("alike", [1024, 2])
def test_every_pair_has_copies_repeated_rows_and_keys_of_several_vectors(spark, monkeypatch, alike):
    monkeypatch.setattr(neighbours, "ALIKE", alike)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)))]
    rows += [(100 + i, rows[3][1]) for i in range(9)] + [(200, rows[5][1]), (200, rows[5][1])]
    rows += [(-1, rows[7][1]), (-1, rows[8][1]), (-1, [-x for x in rows[8][1]]), (None, rows[3][1]), (300, [0.0] * 4), (301, None)]
    found = neighbours.every_pair_above(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.6)
    kept = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and any(v)]
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    expected = [(i, j, round(float(cosine(a, b)), 6)) for i, a in kept for j, b in kept if i < j and cosine(a, b) >= 0.6]
    assert sorted((r["row_a"], r["row_b"], round(r["cosine_similarity"], 6)) for r in found.collect()) == sorted(expected)


def test_every_pair_query_lists_copies_as_its_sql_does(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    from workloads.check import compare

    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(6, 64)).astype(np.float32).tolist()
    rows = [(i, vectors[i % 6], i % 3) for i in range(15)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = entry.queries()["every_pair"](spark, str(tmp_path)).toPandas()
    assert len(found) == 3 * 3 + 3 * 1 and compare(found, db.execute(entry.oracle_sql()["every_pair"]).df()) == ""
