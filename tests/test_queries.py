import pytest

import __spark_entry__ as entry
from workloads.check import compare, connect

SMALL = "/root/testdata/sf0.001"
CHECKED = (
    "leakage_exact", "content_signature", "duplicate_summary", "category_rates", "vocabulary", "binary_metrics",
    "threshold_tradeoff", "cost_selection", "review_budget", "drop_vs_baseline", "best_group_split", "subgroup_metrics",
)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    found = entry.queries()[name](spark, SMALL).toPandas()
    assert compare(found, connect(SMALL).execute(entry.oracle_sql()[name]).df()) == ""


def test_model_separates_learnable_labels(spark):
    from pyspark.sql import functions as F

    from corpaudit.operators import metrics
    from corpaudit.operators.models import LINEAR_SVM, ModelSpec, evaluate_split

    words = F.when(F.col("id") % 5 == 0, "wire money urgent cash").otherwise("steady office engineer team")
    df = spark.range(200).select(
        F.col("id").alias("job_id"), words.alias("combined_text"), (F.col("id") % 5 == 0).cast("int").alias("fraudulent"),
        F.when(F.col("id") % 4 == 1, "test").otherwise("train").alias("part"),
    )
    scored, _ = evaluate_split(df, [ModelSpec("svm", LINEAR_SVM, "text_only", max_iter=10)])
    assert scored.count() == 50
    assert metrics.rank_metrics(scored).first()["average_precision"] == 1.0
