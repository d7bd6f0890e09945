"""Rows without a label, tables without a class, and solvers that end by tolerance."""

import pytest
from pyspark.sql import functions as F

from corpaudit.operators import models, sampling, splits
from corpaudit.operators.errors import error_reasons
from corpaudit.operators.metrics import rank_metrics


@pytest.fixture(scope="module")
def partly_labelled(spark):
    rows = [(i, None if i % 5 == 0 else int(i % 4 == 1), f"g{i // 2}", float(i)) for i in range(40)]
    return spark.createDataFrame(rows, "id int, label int, grp string, score double")


def test_splits_keep_unlabelled_rows(partly_labelled):
    parts = splits.stratified_split(partly_labelled, "id", "label", [1, 2])
    assert parts.count() == 80
    assert {r["part"] for r in parts.filter("label IS NULL").collect()} == {"train"}
    folds = splits.stratified_folds(partly_labelled, "id", "label", 4)
    assert folds.count() == 40
    assert {r["fold"] for r in folds.filter("label IS NULL").collect()} == {-1}
    assert {r["fold"] for r in folds.filter("label IS NOT NULL").collect()} == {0, 1, 2, 3}


def test_unlabelled_rows_change_no_metric(partly_labelled):
    labelled = partly_labelled.filter("label IS NOT NULL")
    tied = labelled.unionByName(labelled.withColumn("label", F.lit(None).cast("int")))
    assert rank_metrics(tied).collect() == rank_metrics(labelled).collect()


def test_group_split_without_a_fit_raises(spark):
    one_group = spark.createDataFrame([(i, int(i == 0), "a") for i in range(50)], "id int, label int, grp string")
    with pytest.raises(ValueError, match="both sides"):
        splits.group_split(one_group, "grp", "label", 1, candidates=5).collect()
    assert splits.group_split(one_group.limit(0), "grp", "label", 1, candidates=5).count() == 0


def test_undersampling_without_negatives_keeps_positives(spark):
    positives = spark.createDataFrame([(i, 1) for i in range(5)], "id int, label int")
    assert sampling.undersample(positives, "id", "label").count() == 5


def test_blank_fields_are_missing(spark):
    row = spark.createDataFrame(
        [("t", "x" * 500, "\n\t", "  ", 1)],
        "title string, description string, company_profile string, requirements string, has_company_logo int",
    )
    reasons = row.select(error_reasons().alias("r")).first()["r"]
    assert "missing company profile" in reasons and "missing requirements text" in reasons


@pytest.mark.parametrize("kind", [models.LINEAR_SVM, models.LOGISTIC])
def test_fits_end_by_tolerance(spark, kind):
    noise = F.xxhash64("id") % 7
    words = F.concat_ws(" ", F.when(F.col("id") % 5 == 0, "wire cash").otherwise("steady office"), noise.cast("string"))
    train = spark.range(200).select(
        F.col("id").alias("job_id"), words.alias("combined_text"),
        F.when(F.col("id") % 11 == 0, 1).otherwise((F.col("id") % 5 == 0).cast("int")).alias("label"),
    )
    fitted = models.fit(models.ModelSpec("m", kind, "text_only"), train)
    longer = models.fit(models.ModelSpec("m", kind, "text_only", max_iter=2 * len(fitted.objectives)), train)
    assert fitted.converged
    assert fitted.objectives[-1] <= longer.objectives[-1] * 1.001
    with pytest.warns(UserWarning, match="stopped at 2 passes"):
        assert not models.fit(models.ModelSpec("m", kind, "text_only", max_iter=2), train).converged
