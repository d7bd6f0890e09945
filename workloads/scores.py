"""Metrics, thresholds, quantiles and result-table queries on score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpaudit.operators import metrics, profile, ranks, reports, thresholds
from corpaudit.operators.models import class_weights, cv_summary, fold_metrics, majority_class
from workloads.views import (
    COUNT_COLUMNS, EVENTS, METRIC_COLUMNS, ORDERS, event_scores, order_scores, rounded, sql_metrics, sql_round,
)

TRADEOFF_COLUMNS = reports.TRADEOFF_COLUMNS
INTERPRETATIONS = {"1-URGENT": "Higher fake recall", "5-LOW": "Higher fake precision"}
RUN_KEYS = ("model", "split_protocol", "seed")


def predict_at_threshold(spark, sf_dir):
    return metrics.predict(event_scores(spark, sf_dir), 25.0).select("id", "predicted")


def confusion(spark, sf_dir):
    return metrics.confusion(event_scores(spark, sf_dir))


def binary_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(event_scores(spark, sf_dir)))


def roc_auc(spark, sf_dir):
    return rounded(metrics.rank_metrics(event_scores(spark, sf_dir)).select("roc_auc"))


def average_precision(spark, sf_dir):
    return rounded(metrics.rank_metrics(event_scores(spark, sf_dir)).select("average_precision"))


def pr_curve(spark, sf_dir):
    return rounded(metrics.pr_curve(event_scores(spark, sf_dir)))


def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(event_scores(spark, sf_dir)))


def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(event_scores(spark, sf_dir)))


def score_quantiles(spark, sf_dir):
    wanted = [1 - rate for rate in thresholds.FLAG_RATES] + thresholds.grid_probabilities()
    return rounded(ranks.order_statistics(event_scores(spark, sf_dir), "score", sorted(set(wanted))))


def threshold_tradeoff(spark, sf_dir):
    return rounded(thresholds.threshold_tradeoff(event_scores(spark, sf_dir)))


def threshold_grid(spark, sf_dir):
    return rounded(thresholds.threshold_grid(event_scores(spark, sf_dir)))


def cost_grid(spark, sf_dir):
    grid = thresholds.threshold_grid(event_scores(spark, sf_dir))
    columns = ["threshold", "false_positives", "false_negatives", "false_negative_cost_value", "total_cost"]
    return rounded(thresholds.cost_grid(grid).select(*columns))


def cost_selection(spark, sf_dir):
    return rounded(thresholds.cost_selection(thresholds.threshold_grid(event_scores(spark, sf_dir))))


def review_budget(spark, sf_dir):
    return rounded(thresholds.review_budget(event_scores(spark, sf_dir)))


def box_stats(spark, sf_dir):
    return rounded(profile.box_stats(order_scores(spark, sf_dir), "model", "score"))


def score_histogram(spark, sf_dir):
    return rounded(profile.score_histogram(event_scores(spark, sf_dir), "label", "score", -100.0, 400.0, 50))


def class_weight_table(spark, sf_dir):
    return rounded(class_weights(event_scores(spark, sf_dir)))


def majority_model(spark, sf_dir):
    return rounded(majority_class(event_scores(spark, sf_dir)))


def score_shift(spark, sf_dir):
    """A doubled score as the edit."""
    before = event_scores(spark, sf_dir)
    after = before.withColumn("score", F.col("score") * 2 + 10)
    return rounded(metrics.score_shift(before, after, "id"))


def runs(spark, sf_dir):
    return metrics.binary_metrics(order_scores(spark, sf_dir), RUN_KEYS)


def repeat_summary(spark, sf_dir):
    return rounded(reports.repeat_summary(runs(spark, sf_dir)))


def drop_vs_baseline(spark, sf_dir):
    return rounded(reports.drop_vs_baseline(runs(spark, sf_dir)))


def per_fold(spark, sf_dir):
    folds = order_scores(spark, sf_dir).withColumns({"fold": F.col("seed"), "threshold": F.lit(0.0)})
    return fold_metrics(folds, ["dataset", "model"])


def cv(spark, sf_dir):
    return cv_summary(per_fold(spark, sf_dir), ["dataset", "model"])


def cv_summary_table(spark, sf_dir):
    return rounded(cv(spark, sf_dir))


def cleaned_cv(spark, sf_dir):
    return cv(spark, sf_dir).filter(F.col("dataset") == "cleaned")


def metric_ranks(spark, sf_dir):
    return rounded(reports.metric_ranks(cleaned_cv(spark, sf_dir)))


def metric_winners(spark, sf_dir):
    return rounded(reports.metric_winners(cleaned_cv(spark, sf_dir)))


def winner_counts(spark, sf_dir):
    return reports.winner_counts(reports.metric_winners(cleaned_cv(spark, sf_dir)))


def best_per_dataset(spark, sf_dir):
    best = reports.best_per_dataset(cv(spark, sf_dir))
    return rounded(best.select("dataset", "model", "average_precision_mean", "roc_auc_mean", "f1_fake_mean"))


def metrics_long(spark, sf_dir):
    return rounded(reports.metrics_long(runs(spark, sf_dir), RUN_KEYS, reports.DROP_METRICS))


def metrics_matrix(spark, sf_dir):
    long = reports.metrics_long(runs(spark, sf_dir), RUN_KEYS, reports.DROP_METRICS)
    return rounded(reports.metrics_matrix(long, RUN_KEYS, reports.DROP_METRICS))


def union_reports(spark, sf_dir):
    """One classification report per dataset, in one table."""
    scores = order_scores(spark, sf_dir)
    reports_of = [
        metrics.classification_report(scores.filter(F.col("dataset") == name)).withColumn("dataset", F.lit(name))
        for name in ("cleaned", "original")
    ]
    return rounded(reports_of[0].unionByName(reports_of[1]))


def model_tradeoff(spark, sf_dir):
    return rounded(reports.model_tradeoff(cleaned_cv(spark, sf_dir), INTERPRETATIONS))


QUERIES = {
    "predict_at_threshold": predict_at_threshold, "confusion": confusion, "binary_metrics": binary_metrics,
    "roc_auc": roc_auc, "average_precision": average_precision, "pr_curve": pr_curve, "roc_curve": roc_curve,
    "classification_report": classification_report, "score_quantiles": score_quantiles,
    "threshold_tradeoff": threshold_tradeoff, "threshold_grid": threshold_grid, "cost_grid": cost_grid,
    "cost_selection": cost_selection, "review_budget": review_budget, "box_stats": box_stats,
    "score_histogram": score_histogram, "class_weights": class_weight_table, "majority_model": majority_model,
    "score_shift": score_shift, "repeat_summary": repeat_summary, "drop_vs_baseline": drop_vs_baseline,
    "cv_summary": cv_summary_table, "metric_ranks": metric_ranks, "metric_winners": metric_winners,
    "winner_counts": winner_counts, "best_per_dataset": best_per_dataset, "metrics_long": metrics_long,
    "metrics_matrix": metrics_matrix, "union_reports": union_reports, "model_tradeoff": model_tradeoff,
}

EVENT_METRICS = EVENTS + "," + sql_metrics("ev", "", "m")


def sql_report(source: str, where: str, lead: str) -> str:
    return f"""
    SELECT {lead} t.* FROM (
      SELECT tp, fp, fn, tn, tp + fn AS nf, tn + fp AS nr,
        coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0) AS pr, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS rr,
        coalesce(2 * tn / nullif(2 * tn + fn + fp, 0)::DOUBLE, 0) AS fr,
        coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS pf, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS rf,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS ff
      FROM (SELECT count(*) FILTER (label = 1 AND score >= 0) AS tp, count(*) FILTER (label = 0 AND score >= 0) AS fp,
        count(*) FILTER (label = 1 AND score < 0) AS fn, count(*) FILTER (label = 0 AND score < 0) AS tn
        FROM {source} {where})
    ) c, LATERAL (VALUES
      ('Real', round(pr, 6), round(rr, 6), round(fr, 6), nr::DOUBLE),
      ('Fake', round(pf, 6), round(rf, 6), round(ff, 6), nf::DOUBLE),
      ('accuracy', round((tp + tn) / (nf + nr)::DOUBLE, 6), round((tp + tn) / (nf + nr)::DOUBLE, 6),
        round((tp + tn) / (nf + nr)::DOUBLE, 6), round((tp + tn) / (nf + nr)::DOUBLE, 6)),
      ('macro avg', round((pr + pf) / 2, 6), round((rr + rf) / 2, 6), round((fr + ff) / 2, 6), (nf + nr)::DOUBLE),
      ('weighted avg', round((pr * nr + pf * nf) / (nf + nr), 6), round((rr * nr + rf * nf) / (nf + nr), 6),
        round((fr * nr + ff * nf) / (nf + nr), 6), (nf + nr)::DOUBLE)
    ) t("class", "precision", recall, f1_score, support)"""


def sql_quantiles(probabilities) -> str:
    """Linear interpolation over the sorted list, written out."""
    listed = ", ".join(f"{p!r}::DOUBLE" for p in probabilities)
    return f"""
sorted AS (SELECT list(score ORDER BY score) AS v, count(*) AS n FROM ev),
q AS (
  SELECT p AS probability, v[floor(p * (n - 1))::BIGINT + 1]
    + (v[ceil(p * (n - 1))::BIGINT + 1] - v[floor(p * (n - 1))::BIGINT + 1]) * (p * (n - 1) - floor(p * (n - 1))) AS quantile
  FROM sorted, (SELECT unnest([{listed}]) AS p)
)"""


def sql_threshold_table(probabilities) -> str:
    return EVENTS + "," + sql_quantiles(probabilities) + """,
levels AS (SELECT DISTINCT quantile AS threshold FROM q UNION SELECT 0),
tc AS (
  SELECT threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp,
    count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 1 AND score < threshold) AS fn,
    count(*) FILTER (label = 0 AND score < threshold) AS tn
  FROM levels, ev GROUP BY threshold
),
tt AS (
  SELECT threshold, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy,
    (coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / 2 AS balanced_accuracy,
    coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS fake_precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS fake_recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS fake_f1,
    (tp + fp) / (tp + fp + fn + tn)::DOUBLE AS predicted_fake_rate,
    tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives
  FROM tc
)"""


GRID = sql_threshold_table(thresholds.grid_probabilities())
COSTS = "(SELECT unnest([1, 2, 5, 10, 20, 50, 100]) AS c)"
RUNS = ORDERS + "," + sql_metrics("oscores", "model, split_protocol, seed", "runs")
FOLDS = ORDERS + "," + sql_metrics("oscores", "dataset, model, seed", "folds")
CV_NAMES = {
    "accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy", "roc_auc": "roc_auc",
    "average_precision": "average_precision", "precision_fake": "fake_precision",
    "recall_fake": "fake_recall", "f1_fake": "fake_f1",
}
CV = FOLDS + ", cv AS (SELECT dataset, model, " + ", ".join(
    f"avg({c}) AS {n}_mean, stddev_pop({c}) AS {n}_std" for n, c in CV_NAMES.items()
) + " FROM folds GROUP BY dataset, model)"
LABELS = list(reports.METRIC_LABELS)
CV_LONG = CV + ", cl AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{reports.METRIC_LABELS[m]}' AS label, '{reports.METRIC_MEANINGS[m]}' AS meaning, model, {m} AS score FROM cv WHERE dataset = 'cleaned'"
    for m in LABELS
) + "), winners AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY metric ORDER BY score DESC, model) = 1)"
DROPS = reports.DROP_METRICS

ORACLES = {
    "predict_at_threshold": f"WITH {EVENTS} SELECT id, (score >= 25)::INT AS predicted FROM ev",
    "confusion": f"""WITH {EVENTS} SELECT sum(label * (score >= 0)::INT)::BIGINT AS true_positives,
        sum((1 - label) * (score >= 0)::INT)::BIGINT AS false_positives,
        sum(label * (score < 0)::INT)::BIGINT AS false_negatives,
        sum((1 - label) * (score < 0)::INT)::BIGINT AS true_negatives FROM ev""",
    "binary_metrics": f"WITH {EVENT_METRICS} SELECT {sql_round(METRIC_COLUMNS)}, {', '.join(COUNT_COLUMNS)} FROM m",
    "roc_auc": f"WITH {EVENT_METRICS} SELECT {sql_round(['roc_auc'])} FROM m",
    "average_precision": f"WITH {EVENT_METRICS} SELECT {sql_round(['average_precision'])} FROM m",
    "pr_curve": f"""WITH {EVENTS}, w AS (SELECT DISTINCT score, sum(label) OVER (ORDER BY score DESC) AS tp,
          count(*) OVER (ORDER BY score DESC) AS n FROM ev)
        SELECT round(score, 6) AS threshold, round(tp / n::DOUBLE, 6) AS precision,
          round(tp / (SELECT sum(label) FROM ev)::DOUBLE, 6) AS recall FROM w""",
    "roc_curve": f"""WITH {EVENTS}, w AS (SELECT DISTINCT score, sum(label) OVER (ORDER BY score DESC) AS tp,
          count(*) OVER (ORDER BY score DESC) AS n FROM ev)
        SELECT round(score, 6) AS threshold,
          round((n - tp) / (SELECT sum(1 - label) FROM ev)::DOUBLE, 6) AS false_positive_rate,
          round(tp / (SELECT sum(label) FROM ev)::DOUBLE, 6) AS true_positive_rate FROM w""",
    "classification_report": f"WITH {EVENTS} {sql_report('ev', '', '')}",
    "score_quantiles": "WITH " + EVENTS + "," + sql_quantiles(
        sorted({*(1 - r for r in thresholds.FLAG_RATES), *thresholds.grid_probabilities()})
    ) + " SELECT round(probability, 6) AS probability, round(quantile, 6) AS quantile FROM q",
    "threshold_tradeoff": "WITH " + sql_threshold_table([1 - r for r in thresholds.FLAG_RATES]) + f"""
        SELECT {sql_round(['threshold'])}, true_positives + false_positives AS flagged_count,
          round(predicted_fake_rate, 6) AS flagged_rate, {', '.join(COUNT_COLUMNS)},
          {sql_round(['accuracy', 'balanced_accuracy', 'fake_precision', 'fake_recall', 'fake_f1'])} FROM tt""",
    "threshold_grid": f"WITH {GRID}, {sql_metrics('ev', '', 'm')} SELECT round(threshold, 6) AS threshold, "
    + ", ".join(f"round(tt.{c}, 6) AS {c}" for c in METRIC_COLUMNS if c not in ("roc_auc", "average_precision"))
    + ", round(m.roc_auc, 6) AS roc_auc, round(m.average_precision, 6) AS average_precision, "
    + ", ".join(f"tt.{c}" for c in COUNT_COLUMNS) + " FROM tt, m",
    "cost_grid": f"""WITH {GRID} SELECT round(threshold, 6) AS threshold, false_positives, false_negatives,
        c AS false_negative_cost_value, false_positives + c * false_negatives AS total_cost FROM tt, {COSTS}""",
    "cost_selection": f"""WITH {GRID} SELECT 1 AS false_positive_cost, c AS false_negative_cost,
        round(threshold, 6) AS selected_threshold, round(predicted_fake_rate, 6) AS selected_flagged_rate,
        false_positives, false_negatives, {sql_round(['fake_precision', 'fake_recall', 'fake_f1'])},
        false_positives + c * false_negatives AS total_cost FROM tt, {COSTS}
        QUALIFY row_number() OVER (PARTITION BY c ORDER BY false_positives + c * false_negatives, false_negatives,
          false_positives, threshold) = 1""",
    "review_budget": f"""WITH {EVENTS}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, md5(id::VARCHAR)) AS k FROM ev),
        b AS (SELECT b, greatest(1, round_even(b * (SELECT count(*) FROM ev), 0))::BIGINT AS n
          FROM (SELECT unnest([0.01, 0.02, 0.05, 0.075, 0.10, 0.15, 0.20])::DOUBLE AS b)),
        t AS (SELECT b, n, sum(label) FILTER (k <= n) AS tp, sum(label) AS p FROM b, r GROUP BY b, n)
        SELECT b AS review_budget_rate, n AS reviewed_count, tp::BIGINT AS true_positives_caught,
          (n - tp)::BIGINT AS false_positives_reviewed, (p - tp)::BIGINT AS false_negatives_left,
          round(tp / n::DOUBLE, 6) AS precision_among_reviewed, round(tp / p::DOUBLE, 6) AS fake_recall_at_budget,
          round(tp / p::DOUBLE, 6) AS share_of_all_fake_caught FROM t""",
    "box_stats": f"""WITH {ORDERS}, q AS (SELECT model, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS med,
          quantile_cont(score, 0.75) AS q3 FROM oscores GROUP BY model)
        SELECT model, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
          round(min(score) FILTER (score >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
          round(max(score) FILTER (score <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
          count(*) FILTER (score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM oscores JOIN q USING (model) GROUP BY model, q1, med, q3""",
    "score_histogram": f"""WITH {EVENTS}, b AS (SELECT label,
          least(greatest(floor((score + 100) / 10) + 1, 1), 50)::BIGINT AS bin FROM ev)
        SELECT label, bin, count(*) AS count, -100.0::DOUBLE + (bin - 1) * 10 AS bin_start,
          round(count(*) / (sum(count(*)) OVER (PARTITION BY label) * 10)::DOUBLE, 6) AS density FROM b GROUP BY label, bin""",
    "class_weights": f"""WITH {EVENTS} SELECT label, count(*) AS n,
        round((SELECT count(*) FROM ev) / (2 * count(*))::DOUBLE, 6) AS weight FROM ev GROUP BY label""",
    "majority_model": f"""WITH {EVENTS} SELECT label AS majority_label,
        round(count(*) / (SELECT count(*) FROM ev)::DOUBLE, 6) AS majority_class_accuracy
        FROM ev GROUP BY label ORDER BY count(*) DESC, label LIMIT 1""",
    "score_shift": f"""WITH {EVENTS} SELECT CASE label WHEN 1 THEN 'fake' ELSE 'real' END AS actual_class,
        round(avg(score), 6) AS mean_original_score, round(avg(score * 2 + 10), 6) AS mean_scenario_score,
        round(avg(score * 2 + 10 - score), 6) AS mean_score_shift,
        round(avg((score * 2 + 10 >= 0)::INT), 6) AS predicted_fake_rate, count(*) AS row_count FROM ev GROUP BY label""",
    "repeat_summary": f"WITH {RUNS} SELECT model, split_protocol, " + ", ".join(
        f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in reports.REPEAT_METRICS
    ) + " FROM runs GROUP BY model, split_protocol",
    "drop_vs_baseline": f"WITH {RUNS}, d AS (SELECT r.model, r.split_protocol, "
    + ", ".join(f"b.{m} - r.{m} AS {m}_drop_vs_random" for m in DROPS)
    + """ FROM runs r LEFT JOIN runs b ON b.model = r.model AND b.seed = r.seed AND b.split_protocol = 'random_stratified'
        WHERE r.split_protocol <> 'random_stratified') SELECT model, split_protocol, """
    + ", ".join(
        f"round(avg({m}_drop_vs_random), 6) AS {m}_drop_vs_random_mean, round(stddev_samp({m}_drop_vs_random), 6) AS {m}_drop_vs_random_std"
        for m in DROPS
    ) + " FROM d GROUP BY model, split_protocol",
    "cv_summary": f"WITH {CV} SELECT dataset, model, "
    + ", ".join(f"round({n}_{s}, 6) AS {n}_{s}" for n in CV_NAMES for s in ("mean", "std")) + " FROM cv",
    "metric_ranks": f"WITH {CV_LONG} SELECT metric, model, round(score, 6) AS score, rank() OVER (PARTITION BY metric ORDER BY score DESC) AS rank FROM cl",
    "metric_winners": f"WITH {CV_LONG} SELECT label AS metric, model AS winning_model, round(score, 6) AS winning_score, meaning AS what_metric_prioritizes FROM winners",
    "winner_counts": f"WITH {CV_LONG} SELECT model, count(*) AS number_of_metrics_won FROM winners GROUP BY model",
    "best_per_dataset": f"""WITH {CV} SELECT dataset, model, {sql_round(['average_precision_mean', 'roc_auc_mean', 'f1_fake_mean'])}
        FROM cv QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY cv.average_precision_mean DESC, model) = 1""",
    "metrics_long": f"WITH {RUNS} " + " UNION ALL ".join(
        f"SELECT model, split_protocol, seed, '{m}' AS metric, round({m}, 6) AS score FROM runs" for m in DROPS
    ),
    "metrics_matrix": f"WITH {RUNS} SELECT model, split_protocol, seed, {sql_round(DROPS)} FROM runs",
    "union_reports": f"WITH {ORDERS} " + " UNION ALL ".join(
        sql_report("oscores", f"WHERE dataset = '{d}'", f"'{d}' AS dataset,") for d in ("cleaned", "original")
    ),
    "model_tradeoff": f"""WITH {CV} SELECT model, {sql_round(TRADEOFF_COLUMNS)},
        CASE model WHEN '1-URGENT' THEN 'Higher fake recall' ELSE 'Higher fake precision' END AS interpretation
        FROM cv WHERE dataset = 'cleaned' AND model IN ('1-URGENT', '5-LOW')""",
}
