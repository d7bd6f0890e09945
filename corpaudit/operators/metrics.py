"""Binary classification metrics on a score table ``(id, label, score, ...)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpaudit.functions.numbers import count_if, ratio, ratio_or_zero
from corpaudit.operators.ranks import prefix_sums

COUNTS = ["true_positives", "false_positives", "false_negatives", "true_negatives"]
METRICS = [
    "accuracy", "balanced_accuracy", "roc_auc", "average_precision",
    "fake_precision", "fake_recall", "fake_f1", "predicted_fake_rate",
]


def predict(scores: DataFrame, threshold: float = 0.0, score: str = "score") -> DataFrame:
    return scores.withColumn("predicted", (F.col(score) >= F.lit(threshold)).cast("int"))


def rates_from_counts(zero_division: bool = True) -> dict[str, Column]:
    """The threshold metrics as algebra over the four counts."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    divide = ratio_or_zero if zero_division else ratio
    return {
        "accuracy": divide(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": (divide(tp, tp + fn) + divide(tn, tn + fp)) / 2.0,
        "fake_precision": divide(tp, tp + fp),
        "fake_recall": divide(tp, tp + fn),
        # F1 stays 0 on an empty group in either mode.
        "fake_f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "predicted_fake_rate": divide(tp + fp, tp + fp + fn + tn),
    }


def confusion(
    scores: DataFrame, by: Sequence[str] = (), threshold: float = 0.0, score: str = "score", label: str = "label"
) -> DataFrame:
    flagged = F.col(score) >= F.lit(threshold)
    positive = F.col(label) == 1
    return scores.groupBy(*by).agg(
        count_if(positive & flagged).alias("true_positives"),
        count_if(~positive & flagged).alias("false_positives"),
        count_if(positive & ~flagged).alias("false_negatives"),
        count_if(~positive & ~flagged).alias("true_negatives"),
    )


def with_rates(counts: DataFrame, zero_division: bool = True) -> DataFrame:
    return counts.withColumns(rates_from_counts(zero_division))


def _rank_aggregates() -> list[Column]:
    pos, n = F.col("pos"), F.col("n")
    area = F.sum((n - pos) * (F.col("cum_pos") - pos / 2.0))
    precision_steps = F.sum(pos * F.col("cum_pos") / F.col("cum_n"))
    total_pos, total_n = F.max("total_pos"), F.max("total_n")
    return [
        # Chance that a positive outranks a negative, ties counting one half.
        F.try_divide(area, (total_pos * (total_n - total_pos)).cast("double")).alias("roc_auc"),
        F.coalesce(F.try_divide(precision_steps, total_pos.cast("double")), F.lit(0.0)).alias("average_precision"),
    ]


def rank_metrics(scores: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """ROC AUC and average precision over distinct scores, exact under ties."""
    return prefix_sums(scores, by, score, label).groupBy(*by).agg(*_rank_aggregates())


def binary_metrics(
    scores: DataFrame,
    by: Sequence[str] = (),
    threshold: float | Column = 0.0,
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """All counts and metrics of each group from one pass over its prefix sums.

    ``threshold`` may be an expression over the ``by`` columns, for models on different scales.
    """
    line = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flagged = F.col(score) >= line
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    sums = prefix_sums(scores, by, score, label)
    counted = sums.groupBy(*by).agg(
        F.sum(F.when(flagged, pos).otherwise(0)).alias("true_positives"),
        F.sum(F.when(flagged, neg).otherwise(0)).alias("false_positives"),
        F.sum(F.when(flagged, 0).otherwise(pos)).alias("false_negatives"),
        F.sum(F.when(flagged, 0).otherwise(neg)).alias("true_negatives"),
        *_rank_aggregates(),
    )
    return with_rates(counted).select(*by, *METRICS, *COUNTS)


def group_metrics(
    scores: DataFrame, by: Sequence[str], threshold: float = 0.0, min_rows: int = 0,
    score: str = "score", label: str = "label",
) -> DataFrame:
    """Per-slice counts and rates; a rate without rows is NULL."""
    flagged = F.col(score) >= F.lit(threshold)
    positive = F.col(label) == 1
    counts = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        count_if(positive).alias("fake_count"),
        count_if(positive & flagged).alias("true_positives"),
        count_if(~positive & flagged).alias("false_positives"),
        count_if(positive & ~flagged).alias("false_negatives"),
        count_if(~positive & ~flagged).alias("true_negatives"),
        F.avg(score).alias("mean_score_for_fake"),
    ).filter(F.col("row_count") >= min_rows)
    return with_rates(counts, zero_division=False).select(
        *by, "row_count", "fake_count",
        ratio(F.col("fake_count"), F.col("row_count")).alias("fake_rate"),
        "predicted_fake_rate", "fake_precision", "fake_recall", "fake_f1",
        ratio(F.col("false_positives"), F.col("false_positives") + F.col("true_negatives"))
        .alias("false_positive_rate_among_real"),
        *COUNTS, "mean_score_for_fake",
    )


def pr_curve(scores: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Precision and recall at every distinct score."""
    return prefix_sums(scores, by, score, label).select(
        *by, F.col(score).alias("threshold"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("recall"),
    )


def roc_curve(scores: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """False and true positive rate at every distinct score."""
    return prefix_sums(scores, by, score, label).select(
        *by, F.col(score).alias("threshold"),
        ratio(F.col("cum_n") - F.col("cum_pos"), F.col("total_n") - F.col("total_pos")).alias("false_positive_rate"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("true_positive_rate"),
    )


def classification_report(scores: DataFrame, by: Sequence[str] = (), threshold: float = 0.0) -> DataFrame:
    """Precision, recall, F1 and support of both classes, accuracy, macro and weighted means."""
    counts = confusion(scores, by, threshold)
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)

    def entry(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1_score"), support.cast("double").alias("support"),
        )

    real = (ratio_or_zero(tn, tn + fn), ratio_or_zero(tn, tn + fp), ratio_or_zero(2 * tn, 2 * tn + fn + fp))
    fake = (ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn), ratio_or_zero(2 * tp, 2 * tp + fp + fn))
    n_real, n_fake = tn + fp, tp + fn
    total = n_real + n_fake
    accuracy = ratio_or_zero(tp + tn, total)
    macro = [(r + f) / 2.0 for r, f in zip(real, fake)]
    weighted = [ratio_or_zero(r * n_real + f * n_fake, total) for r, f in zip(real, fake)]
    rows = F.array(
        entry("Real", *real, n_real),
        entry("Fake", *fake, n_fake),
        entry("accuracy", accuracy, accuracy, accuracy, accuracy),
        entry("macro avg", *macro, total),
        entry("weighted avg", *weighted, total),
    )
    return counts.select(*by, F.inline(rows))


def score_shift(before: DataFrame, after: DataFrame, key: str, threshold: float = 0.0) -> DataFrame:
    """How an edit moves the scores of each class: ``before`` and ``after`` share keys and labels."""
    joined = before.select(key, "label", F.col("score").alias("_original")).join(
        after.select(key, F.col("score").alias("_edited")), key
    )
    return joined.groupBy(
        F.when(F.col("label") == 1, "fake").otherwise("real").alias("actual_class")
    ).agg(
        F.avg("_original").alias("mean_original_score"),
        F.avg("_edited").alias("mean_scenario_score"),
        F.avg(F.col("_edited") - F.col("_original")).alias("mean_score_shift"),
        F.avg((F.col("_edited") >= threshold).cast("double")).alias("predicted_fake_rate"),
        F.count(F.lit(1)).alias("row_count"),
    )
