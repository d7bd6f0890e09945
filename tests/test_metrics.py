import random

import pytest
from pyspark.sql import functions as F

from corpaudit.operators import metrics, ranks, thresholds

TIES = [(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.8), (4, 0, 0.3)]
COLUMNS = "id long, label int, score double"


def brute_auc(rows):
    pos, neg = [s for _, l, s in rows if l], [s for _, l, s in rows if not l]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    def precision(at):
        above = [l for _, l, s in rows if s >= at]
        return sum(above) / len(above)

    pos = [s for _, l, s in rows if l]
    return sum(precision(s) for s in pos) / len(pos)


def skewed_rows(n=600, seed=3):
    """Half of the rows share one score."""
    rng = random.Random(seed)
    return [(i, int(rng.random() < 0.2), 0.5 if rng.random() < 0.5 else round(rng.uniform(-2, 2), 2)) for i in range(n)]


@pytest.mark.parametrize("rows", [TIES, skewed_rows(), skewed_rows(300, 8)])
@pytest.mark.parametrize("partitions", [1, 7])
def test_rank_metrics_match_quadratic_formula(spark, rows, partitions):
    got = metrics.rank_metrics(spark.createDataFrame(rows, COLUMNS).repartition(partitions)).first()
    assert got["roc_auc"] == pytest.approx(brute_auc(rows), abs=1e-12)
    assert got["average_precision"] == pytest.approx(brute_ap(rows), abs=1e-12)


def test_one_class_has_no_auc_and_zero_rates(spark):
    got = metrics.binary_metrics(spark.createDataFrame([(1, 0, -1.0), (2, 0, -2.0)], COLUMNS)).first()
    assert got["roc_auc"] is None and got["average_precision"] == 0 and got["fake_precision"] == 0


def test_empty_denominators_of_slices_are_null(spark):
    rows = [("a", 0, -1.0), ("a", 0, -1.0), ("b", 1, 1.0)]
    got = {r["g"]: r for r in metrics.group_metrics(spark.createDataFrame(rows, "g string, label int, score double"), ["g"]).collect()}
    assert got["a"]["fake_precision"] is None and got["a"]["fake_recall"] is None and got["a"]["fake_f1"] == 0
    assert got["b"]["false_positive_rate_among_real"] is None and got["b"]["fake_recall"] == 1


def test_quantiles_are_linear_and_exact(spark):
    import numpy as np

    rows = skewed_rows(501)
    values = [s for _, _, s in rows]
    probabilities = [0.0, 0.03, 0.25, 0.5, 0.9, 0.97, 1.0]
    got = ranks.quantile_values(spark.createDataFrame(rows, COLUMNS), "score", probabilities)
    assert got == pytest.approx(list(np.quantile(values, probabilities)), abs=1e-12)


def test_cut_points_do_not_change_results(spark):
    df = spark.createDataFrame(skewed_rows(), COLUMNS)
    plain = ranks.prefix_sums(df, cuts=[]).orderBy("score").collect()
    assert plain == ranks.prefix_sums(df, cuts=[-1.5, -1.0, 0.5, 0.51, 1.9]).orderBy("score").collect()


def test_threshold_counts_add_up(spark):
    rows = skewed_rows()
    positives = sum(l for _, l, _ in rows)
    for r in thresholds.at_thresholds(spark.createDataFrame(rows, COLUMNS), [-5.0, 0.0, 0.5, 5.0]).collect():
        assert r["true_positives"] + r["false_negatives"] == positives
        assert r["true_positives"] + r["false_positives"] == sum(s >= r["threshold"] for _, _, s in rows)


def test_review_budget_rounds_half_even_and_splits_ties(spark):
    scores = spark.range(4470).select(
        "id", (F.col("id") % 20 == 0).cast("int").alias("label"), F.lit(1.0).alias("score")
    )
    got = {r["review_budget_rate"]: r for r in thresholds.review_budget(scores).collect()}
    assert got[0.15]["reviewed_count"] == 670
    for r in got.values():
        assert r["true_positives_caught"] + r["false_positives_reviewed"] == r["reviewed_count"]
        assert r["true_positives_caught"] + r["false_negatives_left"] == 224


def test_misses_never_rise_with_their_cost(spark):
    grid = thresholds.threshold_grid(spark.createDataFrame(skewed_rows(), COLUMNS), steps=20)
    chosen = thresholds.cost_selection(grid).orderBy("false_negative_cost").collect()
    misses = [r["false_negatives"] for r in chosen]
    assert misses == sorted(misses, reverse=True)
    assert all(r["total_cost"] == r["false_positives"] + r["false_negative_cost"] * r["false_negatives"] for r in chosen)


def test_no_row_scale_single_partition_exchange(spark):
    plan = ranks.prefix_sums(spark.createDataFrame(skewed_rows(), COLUMNS))._jdf.queryExecution().optimizedPlan().toString()
    assert "cartesian" not in plan.lower()
    physical = ranks.prefix_sums(spark.createDataFrame(skewed_rows(), COLUMNS))._jdf.queryExecution().executedPlan().toString()
    for line_number, line in enumerate(physical.splitlines()):
        if "SinglePartition" in line:
            below = physical.splitlines()[line_number + 1]
            assert "_bucket" in below, below
