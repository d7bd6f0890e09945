import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpaudit.operators import components, duplicates, neighbours, sampling, splits, topics
from corpaudit.plans import studies
from corpaudit.operators.topics import fit_topics, right_singular_vectors
from corpaudit.sources import corpus, results


def labelled(spark, n=1000, hot=0.4):
    """One group holds ``hot`` of all rows and both labels."""
    return spark.range(n).select(
        F.col("id"), (F.col("id") % 11 == 0).cast("int").alias("label"),
        F.when(F.col("id") < n * hot, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string"))).alias("grp"),
    )


def test_stratified_sizes_and_repeatability(spark):
    df = labelled(spark)
    parts = splits.stratified_split(df, "id", "label", [7, 13])
    again = splits.stratified_split(df.repartition(5), "id", "label", [7, 13])
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, again.collect()))
    for r in splits.split_stats(parts, "label", ["seed"]).collect():
        assert (r["test_rows"], r["test_fake_count"]) == (250, 23)


def test_folds_are_even_within_classes(spark):
    sizes = splits.stratified_folds(labelled(spark), "id", "label").groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


@pytest.mark.parametrize("candidates", [1, 20])
def test_group_splits_never_leak(spark, candidates):
    parts = splits.group_split(labelled(spark), "grp", "label", 3, candidates)
    assert duplicates.leakage(parts, "grp").first()["test_rows_with_train_cluster"] == 0
    groups = parts.filter("part = 'test'").select("grp").distinct().count()
    assert groups == math.ceil(0.25 * parts.select("grp").distinct().count())


def test_order_split_and_unknown_protocol(spark):
    df = spark.range(2**53, 2**53 + 10)
    train = splits.order_split(df, "id").filter("part = 'train'").agg(F.count("*"), F.max("id")).first()
    assert tuple(train) == (8, 2**53 + 7)
    with pytest.raises(ValueError, match="Unknown split protocol"):
        splits.split_by_protocol(labelled(spark), "other", 1, "id", "label")


def test_leakage_with_a_hot_group(spark):
    df = labelled(spark, 100).withColumn("part", F.when(F.col("id") % 4 == 0, "test").otherwise("train"))
    rows = df.collect()
    train = {r["grp"] for r in rows if r["part"] == "train"}
    leaked = [r for r in rows if r["part"] == "test" and r["grp"] in train]
    got = duplicates.leakage(df, "grp").first()
    assert got["test_rows_with_train_cluster"] == len(leaked)
    assert got["overlapping_clusters"] == len({r["grp"] for r in leaked})


def test_mixed_label_summary(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), ("b", 0), ("c", 1)], "g string, y int")
    got = duplicates.duplicate_summary(duplicates.duplicate_groups(df, "g", "y")).first()
    assert (got["rows"], got["unique_content_signatures"], got["duplicate_signature_groups"]) == (5, 3, 2)
    assert (got["mixed_label_duplicate_groups"], got["fake_rate_duplicate_rows"]) == (1, 0.25)


def test_resampling_sizes(spark):
    df = labelled(spark)
    assert sampling.class_sizes(sampling.undersample(df, "id", "label"), "label") == {0: 91, 1: 91}
    assert sampling.class_sizes(sampling.oversample(df, "id", "label"), "label") == {0: 909, 1: 909}
    assert sampling.class_sizes(sampling.oversample(df, "id", "label", 0.2), "label") == {0: 909, 1: 227}
    with pytest.raises(ValueError, match="Unknown strategy"):
        sampling.resample_training(df, "id", "label", "other")


@pytest.mark.parametrize("size", [40, 150, 600])
def test_prevalence_samples_take_leave_out_and_repeat(spark, size):
    """91 positives and 909 negatives: drawn for, drawn around, or drawn with repeats."""
    scores = labelled(spark).withColumn("score", F.lit(0.0))
    got = sampling.prevalence_samples(scores, "id", [0.5], size, 3).groupBy("repeat", "label").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("d")
    ).collect()
    assert len(got) == 6
    for r in got:
        assert r["n"] == size // 2
        assert r["d"] == r["n"] if r["n"] <= (91 if r["label"] else 909) else r["d"] <= 91


def test_label_scarcity_counts(spark):
    runs = sampling.label_scarcity_samples(labelled(spark), "id", "label", (50, 200), 2)
    got = {(r[0], r[1]): (r[2], r[3]) for r in runs.groupBy("fake_labels_available", "repeat").agg(
        F.sum("label"), F.sum(1 - F.col("label"))).collect()}
    assert got == {(c, r): (c, 909) for c, r in [(50, 0), (50, 1), (200, 0), (200, 1), (91, 0)]}


def brute_neighbours(vectors, k):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = units @ units.T
    return {
        i: [j for _, j in sorted((-round(sims[i, j], 9), j) for j in range(len(units)) if j != i)[:k]]
        for i in range(len(units))
    }


@pytest.mark.parametrize("chunk", [4096, 16])
def test_neighbours_match_brute_force_with_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(120, 4))
    clump = np.array([1.0, 2, 3, 4]) + rng.normal(scale=0.01, size=(50, 4))
    copies = np.repeat(spread[:1], 60, axis=0)
    vectors = np.vstack([spread, clump, copies])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    got = {}
    for r in neighbours.nearest(df, "id", "v", 5).orderBy("id", F.desc("similarity"), "other").collect():
        got.setdefault(r["id"], []).append(r["other"])
    expected = brute_neighbours(vectors, 5)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in expected.items()}
    floor = neighbours.nearest(df, "id", "v", 5, 0.999).count()
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert floor == sum((units[i] @ units[j]) >= 0.999 for i, js in expected.items() for j in js)


def test_components_of_chain_star_and_copies(spark):
    chain = [(i, i + 1) for i in range(10, 15)]
    star = [(20, i) for i in range(21, 26)]
    edges = spark.createDataFrame(chain + star + [(30, 31), (31, 30), (40, 40)], "u long, v long")
    got = {r["node"]: r["cluster"] for r in components.connected_components(edges).collect()}
    expected = {**{i: 10 for i in range(10, 16)}, **{i: 20 for i in range(20, 26)}, 30: 30, 31: 30}
    assert got == expected


def test_clusters_keep_singletons(spark):
    pairs = spark.createDataFrame([(1, 2, 0.99), (2, 3, 0.5)], "row_a long, row_b long, cosine_similarity double")
    got = components.clusters(spark.range(1, 5), "id", pairs, 0.98).collect()
    assert {r["id"]: r["cluster"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_singular_vectors_match_numpy(spark):
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 12))
    rows = [(i, list(range(12)), r.tolist()) for i, r in enumerate(matrix)]
    df = spark.createDataFrame(rows, "id long, indices array<int>, values array<double>")
    vectors, strength = right_singular_vectors(df, 12, 3)
    truth = np.linalg.svd(matrix)
    assert strength == pytest.approx(truth[1][:3])
    assert np.abs(np.sum(vectors * truth[2][:3].T, axis=0)) == pytest.approx(np.ones(3))


def test_partial_sums_follow_the_cores(spark, monkeypatch):
    """However many pieces the rows are in, the partial sums of a pass are no more than run at a time."""
    rng, pieces, plain = np.random.default_rng(3), [], topics._summed
    matrix = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, list(range(5)), r.tolist()) for i, r in enumerate(matrix)], "id long, indices array<int>, values array<double>")

    def summed(partial, *rest):
        pieces.append(partial.rdd.getNumPartitions())
        return plain(partial, *rest)

    monkeypatch.setattr(topics, "_summed", summed)
    many, basis = df.repartition(40), rng.normal(size=(5, 3))
    assert topics._gram_product(many, basis) == pytest.approx(matrix.T @ matrix @ basis)
    topics._column_sums(many, np.abs(basis.T))
    assert len(pieces) == 2 and max(pieces) <= spark.sparkContext.defaultParallelism


def test_topics_separate_two_subjects(spark):
    texts = ["apple pear apple plum", "pear plum apple", "engine wheel brake", "brake engine engine"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    model = fit_topics(df, "id", "t", topics=2)
    topic = {r["id"]: r["topic"] for r in model.assign().collect()}
    assert topic[0] == topic[1] != topic[2] == topic[3]
    assert model.top_terms(2).count() == 2


def test_csv_round_trip_and_resumable_runs(spark, tmp_path):
    path = tmp_path / "jobs.csv"
    path.write_text('job_id,title,fraudulent\n1,"two\nlines, ""quoted""",0\n2,,1\n')
    df = corpus.read_corpus(spark, str(path))
    assert df.orderBy("job_id").first()["title"] == 'two\nlines, "quoted"'
    bad = tmp_path / "bad.csv"
    bad.write_text("job_id\n1\n")
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, str(bad))
    results.write_table(df, str(tmp_path), "out", "csv")
    assert results.read_tables(spark, str(tmp_path), ["out"], "csv")["out"].count() == 2
    wanted = spark.createDataFrame([("a", 1), ("b", 1)], "model string, seed int")
    assert results.missing_runs(wanted, str(tmp_path), "runs", ["model", "seed"]).count() == 2
    done = spark.createDataFrame([("a", 1, 0.5)], "model string, seed int, f1 double")
    results.append_run(done, str(tmp_path), "runs", ["model", "seed"])
    results.append_run(done, str(tmp_path), "runs", ["model", "seed"])
    assert results.read_table(spark, str(tmp_path), "runs").count() == 1
    assert results.missing_runs(wanted, str(tmp_path), "runs", ["model", "seed"]).first()["model"] == "b"


def test_leakage_of_all_seeds_at_once(spark):
    rows = [(i, None if i % 50 == 0 else int(i % 7 == 0), "hot" if i < 120 else None if i % 9 == 0 else f"g{i % 61}", f"s{i // 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "job_id long, fraudulent int, grp string, pair string").repartition(5)
    seeds = [7, 13, 23]
    found = studies.leakage_by_seed(df, ["grp", "pair"], seeds)
    parts = splits.stratified_split(df, "job_id", "fraudulent", seeds)
    for group in ("grp", "pair"):
        plain = sorted(map(tuple, duplicates.leakage(parts, group, ["seed"]).collect()))
        mine = found.filter(F.col("cluster_type") == group).drop("cluster_type")
        assert sorted(map(tuple, mine.collect())) == plain and len(plain) == len(seeds)
    assert studies.leakage_by_seed(df.limit(0), ["grp"], seeds).count() == 0


def seed_marks_multiply_no_rows(spark):
    df = labelled(spark)
    marked = splits.seed_marks(df, "id", "label", [7, 13], ["a", "b"])
    assert marked.count() == df.count() and "Generate" not in marked.drop("a", "b")._jdf.queryExecution().optimizedPlan().toString()
    for seed, name in ((7, "a"), (13, "b")):
        parts = splits.stratified_split(df, "id", "label", [seed]).filter("part = 'test'")
        assert {r.id for r in marked.filter(name).collect()} == {r.id for r in parts.collect()}


def test_a_broken_study_fits_only_its_missing_runs(spark, tmp_path, monkeypatch):
    df = spark.range(200).select(
        F.col("id").alias("job_id"), (F.col("id") % 5 == 0).cast("int").alias("fraudulent"),
        F.concat(F.lit("e"), (F.col("id") % 40).cast("string")).alias("exact_signature"),
    )
    fitted, broken = [], [True]

    def scores(parts, specs, key, target):
        if broken[0] and len(fitted) == 3:
            raise RuntimeError("lost")
        fitted.append(1)
        score = F.when(F.col(key) % 3 == 0, 1.0).otherwise(-1.0)
        test = parts.filter("part = 'test'").select(F.lit("m").alias("model"), F.lit(0.0).alias("threshold"), key, F.col(target).alias("label"), score.alias("score"))
        return test, {}

    monkeypatch.setattr(studies, "evaluate_split", scores)
    monkeypatch.setattr(studies, "in_parallel", lambda tasks, threads=4: [task() for task in tasks])
    run = lambda ledger: studies.leakage_runs(df, [7, 13], (), splits.PROTOCOLS[:2], ledger)
    with pytest.raises(RuntimeError):
        run(str(tmp_path))
    broken[0] = False
    resumed = run(str(tmp_path))
    assert len(fitted) == 4 and resumed.count() == 4
    columns = sorted(resumed.columns)
    whole = run(None)
    assert sorted(whole.columns) == columns and len(fitted) == 8
    assert sorted(map(tuple, resumed.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    run(str(tmp_path))
    assert len(fitted) == 8


def test_leakage_matrix_query_runs_every_seed_of_the_study(spark, monkeypatch):
    from pyspark.sql import functions as F

    from corpaudit.operators import models
    from corpaudit.plans import studies
    from workloads import modelling

    rows = spark.range(40).select(
        F.col("id").alias("job_id"), (F.col("id") % 4 == 0).cast("int").alias("fraudulent"),
        F.col("id").cast("string").alias("exact_signature"), F.col("id").alias("near_template_cluster_098"))

    def scored(parts, specs, key, label, **_):
        test = parts.filter("part = 'test'").select(key, F.col(label).alias("label"), (F.col(key) % 3 - 1.0).alias("score"))
        return models.union_all([test.select(F.lit(s.name).alias("model"), F.lit(s.threshold).alias("threshold"), "*") for s in specs]), {}

    monkeypatch.setattr(modelling, "near_clustered", lambda spark, sf_dir: rows)
    monkeypatch.setattr(studies, "evaluate_split", scored)
    found = modelling.leakage_matrix(spark, "").select("model", "split_protocol", "seed").collect()
    assert len(found) == len(set(found)) == len(studies.LEAKAGE_MODELS) * 3 * 5
    assert {r["seed"] for r in found} == set(studies.LEAKAGE_SEEDS)
