"""Threshold, review-budget and cost trade-offs on a score table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from corpaudit.functions.numbers import ratio, ratio_or_zero
from corpaudit.operators.metrics import COUNTS, rank_metrics, with_rates
from corpaudit.operators.ranks import prefix_sums, quantile_values, rank_cutoffs, with_bucket

# The study's grids.
FLAG_RATES = (0.03, 0.04, 0.05, 0.075, 0.10, 0.15)
REVIEW_BUDGETS = (0.01, 0.02, 0.05, 0.075, 0.10, 0.15, 0.20)
FALSE_NEGATIVE_COSTS = (1, 2, 5, 10, 20, 50, 100)
GRID_STEPS = 500


def at_thresholds(scores: DataFrame, thresholds: Sequence[float], score: str = "score", label: str = "label") -> DataFrame:
    """Counts and metrics at each threshold (``score >= threshold`` is flagged).

    Every score goes to the last threshold at or below it (binary search in the JVM), the bins are
    counted with a map-side combine, and the running sum sees one row per threshold. No row meets
    more than one threshold.
    """
    levels = sorted({float(t) for t in thresholds})
    binned = with_bucket(scores.select(F.col(score).cast("double").alias(score), label), score, levels)
    per_bin = binned.groupBy(F.col("_bucket").cast("int").alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    # Bin 0 lies below every threshold, bin i starts at threshold i.
    spark = scores.sparkSession
    ladder = spark.createDataFrame(
        [(0, None)] + [(i + 1, level) for i, level in enumerate(levels)], "_bin int, threshold double"
    )
    # levels + 1 rows, a parameter of the call
    filled = ladder.join(per_bin, "_bin", "left").fillna(0, ["n", "pos"])
    upwards = Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    counted = filled.select(
        "threshold",
        F.sum("n").over(upwards).alias("_flagged"),
        F.sum("pos").over(upwards).alias("true_positives"),
        F.sum("n").over(whole).alias("_total"),
        F.sum("pos").over(whole).alias("_positives"),
    ).filter(F.col("threshold").isNotNull())
    counts = counted.select(
        "threshold",
        "true_positives",
        (F.col("_flagged") - F.col("true_positives")).alias("false_positives"),
        (F.col("_positives") - F.col("true_positives")).alias("false_negatives"),
        (F.col("_total") - F.col("_flagged") - F.col("_positives") + F.col("true_positives")).alias("true_negatives"),
    )
    return with_rates(counts)


def threshold_tradeoff(scores: DataFrame, flag_rates: Sequence[float] = FLAG_RATES) -> DataFrame:
    """Metrics at the thresholds that flag the given shares, and at 0."""
    edges = quantile_values(scores, "score", [1 - rate for rate in flag_rates])
    table = at_thresholds(scores, [*edges, 0.0])
    return table.select(
        "threshold",
        (F.col("true_positives") + F.col("false_positives")).alias("flagged_count"),
        F.col("predicted_fake_rate").alias("flagged_rate"),
        *COUNTS, "accuracy", "balanced_accuracy", "fake_precision", "fake_recall", "fake_f1",
    )


def grid_probabilities(steps: int = GRID_STEPS) -> list[float]:
    """Evenly spaced probabilities from 0 to 1, built by repeated step."""
    step = 1.0 / steps
    return [*(i * step for i in range(steps)), 1.0]


def threshold_grid(scores: DataFrame, steps: int = GRID_STEPS) -> DataFrame:
    """Metrics at ``steps + 1`` score quantiles and at 0; the rank metrics repeat on each row."""
    edges = quantile_values(scores, "score", grid_probabilities(steps))
    ranks = rank_metrics(scores)
    # one row
    return at_thresholds(scores, [*edges, 0.0]).crossJoin(F.broadcast(ranks))


def cost_grid(grid: DataFrame, costs: Sequence[int] = FALSE_NEGATIVE_COSTS) -> DataFrame:
    """Each threshold under each price of a missed positive: ``FP + c * FN``."""
    return (
        grid.withColumn("false_negative_cost_value", F.explode(F.array(*[F.lit(int(c)) for c in costs])))
        .withColumn("false_positive_cost_value", F.lit(1))
        .withColumn("false_positive_cost", F.col("false_positives"))
        .withColumn("false_negative_cost", F.col("false_negatives") * F.col("false_negative_cost_value"))
        .withColumn("total_cost", F.col("false_positive_cost") + F.col("false_negative_cost"))
    )


def cost_selection(grid: DataFrame, costs: Sequence[int] = FALSE_NEGATIVE_COSTS) -> DataFrame:
    """The cheapest threshold per price; ties go to fewer misses, fewer alarms, lower threshold."""
    best = F.min_by(
        F.struct("threshold", "predicted_fake_rate", "false_positives", "false_negatives",
                 "fake_precision", "fake_recall", "fake_f1", "total_cost"),
        F.struct("total_cost", "false_negatives", "false_positives", "threshold"),
    )
    chosen = cost_grid(grid, costs).groupBy("false_negative_cost_value").agg(best.alias("_best"))
    return chosen.select(
        F.lit(1).alias("false_positive_cost"),
        F.col("false_negative_cost_value").alias("false_negative_cost"),
        F.col("_best.threshold").alias("selected_threshold"),
        F.col("_best.predicted_fake_rate").alias("selected_flagged_rate"),
        "_best.false_positives", "_best.false_negatives", "_best.fake_precision",
        "_best.fake_recall", "_best.fake_f1", "_best.total_cost",
    )


def review_budget(
    scores: DataFrame, budgets: Sequence[float] = REVIEW_BUDGETS, key: str = "id"
) -> DataFrame:
    """What is caught when only the top share by score can be reviewed.

    The prefix sums place every cut inside one run of equal scores. Runs above the cut are counted
    from the sums. Of the run that is cut, the rows with the smallest ``md5(key)`` are taken, found
    by their cutoff hash, so not even a run that holds most of the rows is sorted.
    """
    sums = prefix_sums(scores)
    wanted = F.explode(F.array(*[F.lit(float(b)) for b in budgets]))
    cut_runs = (
        sums.withColumn("review_budget_rate", wanted)
        .withColumn(
            "reviewed_count",
            F.greatest(F.lit(1), F.bround(F.col("total_n") * F.col("review_budget_rate"), 0)).cast("long"),
        )
        .filter(
            (F.col("cum_n") - F.col("n") < F.col("reviewed_count")) & (F.col("reviewed_count") <= F.col("cum_n"))
        )
        .select(
            "review_budget_rate", "reviewed_count", "total_pos", F.col("score").alias("_cut"),
            (F.col("reviewed_count") - (F.col("cum_n") - F.col("n"))).alias("_take"),
            (F.col("cum_pos") - F.col("pos")).alias("_pos_above"),
        )
    )
    # cut_runs holds one row per budget, a parameter of the call
    in_run = scores.select(
        "label", F.col("score").cast("double").alias("_cut"), F.md5(F.col(key).cast("string")).alias("_hash")
    ).join(F.broadcast(cut_runs.select("review_budget_rate", "_cut")), "_cut")
    cutoffs = rank_cutoffs(
        in_run, ["review_budget_rate"], "_hash", F.col("_take"), cut_runs.select("review_budget_rate", "_take")
    )
    taken = (
        in_run.join(F.broadcast(cutoffs), "review_budget_rate")
        .filter(F.col("_hash") <= F.col("cutoff"))
        .groupBy("review_budget_rate")
        .agg(F.sum(F.col("label").cast("long")).alias("_pos_cut"))
    )
    caught = F.col("_pos_above") + F.coalesce(F.col("_pos_cut"), F.lit(0))
    return (
        cut_runs.join(taken, "review_budget_rate", "left")
        .withColumn("true_positives_caught", caught)
        .select(
            "review_budget_rate", "reviewed_count", "true_positives_caught",
            (F.col("reviewed_count") - F.col("true_positives_caught")).alias("false_positives_reviewed"),
            (F.col("total_pos") - F.col("true_positives_caught")).alias("false_negatives_left"),
            ratio(F.col("true_positives_caught"), F.col("reviewed_count")).alias("precision_among_reviewed"),
            ratio_or_zero(F.col("true_positives_caught"), F.col("total_pos")).alias("fake_recall_at_budget"),
            ratio_or_zero(F.col("true_positives_caught"), F.col("total_pos")).alias("share_of_all_fake_caught"),
        )
    )
