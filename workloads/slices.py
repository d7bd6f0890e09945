"""Error slices and case tables over scored postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpaudit.operators import counterfactual, errors
from corpaudit.plans.studies import CONTRAST_FEATURES, PROFILE_MEANS, SUBGROUP_FEATURES
from corpaudit.roles import POSTING_ROLES
from workloads.views import BLANK, PREPARED, SCORED, TEXTS, postings, rounded, scored_postings, sql_combined, sql_normalised, sql_words

LENGTHS = tuple(f"{c}_length" for c in TEXTS)
BINARY = POSTING_ROLES.binary
CATEGORIES = ("industry", "function", "employment_type", "required_experience", "required_education")
CASES = ", ".join(f'"{c}"' for c in errors.CASE_COLUMNS)


def grouped(spark, sf_dir):
    return errors.with_groups(scored_postings(spark, sf_dir))


def prediction_groups(spark, sf_dir):
    return grouped(spark, sf_dir).select("job_id", "predicted", "prediction_group")


def error_counts(spark, sf_dir):
    return errors.error_counts(grouped(spark, sf_dir))


def error_profile(spark, sf_dir):
    return rounded(errors.error_profile(grouped(spark, sf_dir), PROFILE_MEANS))


def error_contrasts(spark, sf_dir):
    return rounded(errors.error_contrasts(grouped(spark, sf_dir), CONTRAST_FEATURES))


def binary_error_rates(spark, sf_dir):
    return rounded(errors.binary_error_rates(grouped(spark, sf_dir), BINARY))


def length_buckets(spark, sf_dir):
    return errors.length_buckets(postings(spark, sf_dir), LENGTHS, ["job_id"]).drop("characters")


def length_bucket_error_rates(spark, sf_dir):
    return rounded(errors.length_bucket_error_rates(grouped(spark, sf_dir), LENGTHS))


def error_top_categories(spark, sf_dir):
    return rounded(errors.top_categories(grouped(spark, sf_dir), CATEGORIES))


def subgroup_metrics(spark, sf_dir):
    return rounded(errors.subgroup_metrics(scored_postings(spark, sf_dir), SUBGROUP_FEATURES))


def score_summary(spark, sf_dir):
    return rounded(errors.score_summary(grouped(spark, sf_dir)))


def false_positives(spark, sf_dir):
    return rounded(errors.false_positives(grouped(spark, sf_dir)))


def false_negatives(spark, sf_dir):
    return rounded(errors.false_negatives(grouped(spark, sf_dir)))


def top_false_positives(spark, sf_dir):
    return rounded(errors.false_positives(grouped(spark, sf_dir), 25))


def top_false_negatives(spark, sf_dir):
    return rounded(errors.false_negatives(grouped(spark, sf_dir), 25))


def borderline_cases(spark, sf_dir):
    return rounded(errors.borderline_cases(grouped(spark, sf_dir)))


def least_confident_correct(spark, sf_dir):
    return rounded(errors.borderline_cases(grouped(spark, sf_dir), only_correct=True))


def confident_mistakes(spark, sf_dir):
    return rounded(errors.confident_mistakes(grouped(spark, sf_dir)))


def error_examples(spark, sf_dir):
    return rounded(errors.error_examples(grouped(spark, sf_dir)))


def error_cases(spark, sf_dir):
    return rounded(errors.error_cases(scored_postings(spark, sf_dir)))


EDITED = (
    "job_id", "company_profile", "benefits", *counterfactual.EDITED_FLAGS, "company_profile_length",
    "benefits_length", "company_profile_word_count", "benefits_word_count",
)


def counterfactual_remove(spark, sf_dir):
    edited = counterfactual.remove_credibility(postings(spark, sf_dir))
    return edited.select(*EDITED, F.sha1("combined_text").alias("text_hash"))


def counterfactual_add(spark, sf_dir):
    edited = counterfactual.add_generic_credibility(postings(spark, sf_dir))
    return edited.select(*EDITED, F.sha1("combined_text").alias("text_hash"))


def low_score_examples(spark, sf_dir):
    """Five lowest scores per group, groups being sources."""
    from corpaudit.operators.reports import lowest_per_group

    lowest = lowest_per_group(scored_postings(spark, sf_dir), "industry", "score", "job_id")
    return rounded(lowest.select("industry", "job_id", "score", F.substring("combined_text", 1, 300).alias("text_snippet")))


QUERIES = {
    "prediction_groups": prediction_groups, "error_counts": error_counts, "error_profile": error_profile,
    "error_contrasts": error_contrasts, "binary_error_rates": binary_error_rates, "length_buckets": length_buckets,
    "length_bucket_error_rates": length_bucket_error_rates, "error_top_categories": error_top_categories,
    "subgroup_metrics": subgroup_metrics, "score_summary": score_summary, "false_positives": false_positives,
    "false_negatives": false_negatives, "top_false_positives": top_false_positives,
    "top_false_negatives": top_false_negatives, "borderline_cases": borderline_cases,
    "least_confident_correct": least_confident_correct, "confident_mistakes": confident_mistakes,
    "error_examples": error_examples, "error_cases": error_cases, "counterfactual_remove": counterfactual_remove,
    "counterfactual_add": counterfactual_add, "low_score_examples": low_score_examples,
}

GROUPS = {"tp": "True positive", "fn": "False negative", "fp": "False positive", "tn": "True negative"}
ERROR_COLUMNS = """count(*) AS row_count, count(*) FILTER (label = 0) AS real_count, count(*) FILTER (label = 1) AS fake_count,
  count(*) FILTER (label = 0 AND predicted = 1) AS false_positive_count,
  round(avg(predicted) FILTER (label = 0), 6) AS false_positive_rate_among_real,
  count(*) FILTER (label = 1 AND predicted = 0) AS false_negative_count,
  round(avg(1 - predicted) FILTER (label = 1), 6) AS false_negative_rate_among_fake"""


def union_columns(columns, select):
    return " UNION ALL ".join(select(c) for c in columns)


def sql_cases(where: str, order: str, top: int, extra: str = "", snippet: int = 240) -> str:
    return f"""(SELECT {extra} {CASES}, CASE label WHEN 1 THEN 'Fake' ELSE 'Real' END AS actual_label,
      CASE predicted WHEN 1 THEN 'Fake' ELSE 'Real' END AS predicted_label, round(score, 6) AS model_score_for_fake,
      substr(regexp_replace(description, '{BLANK}', ' ', 'g'), 1, {snippet}) AS description_snippet
      FROM grouped WHERE {where} ORDER BY {order}, job_id LIMIT {top})"""


FP, FN = "prediction_group = 'False positive'", "prediction_group = 'False negative'"
BUCKETS = """, long AS (""" + union_columns(
    LENGTHS, lambda c: f"SELECT job_id, label, predicted, '{c}' AS text_field, {c}::DOUBLE AS x FROM grouped"
) + """), edges AS (
  SELECT text_field, list_sort(list_distinct(quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM long GROUP BY text_field
), bucketed AS (
  SELECT long.*, len(list_filter(e[2:-2], lambda b: b < x)) AS length_bucket FROM long JOIN edges USING (text_field) WHERE len(e) >= 2
)"""
REASONS = f"""list_filter([
  CASE WHEN regexp_matches(lower(title || ' ' || description), 'money|earn|link|click|home|remote')
    THEN 'contains terms that may resemble scam or remote-work language' END,
  CASE WHEN {sql_normalised('company_profile')} = '' THEN 'missing company profile' END,
  CASE WHEN {sql_normalised('requirements')} = '' THEN 'missing requirements text' END,
  CASE WHEN length(description) < 400 THEN 'short description' END,
  CASE WHEN has_company_logo = 0 THEN 'no company logo' END], lambda x: x IS NOT NULL)"""
REASON = f"""CASE WHEN len({REASONS}) = 0 THEN 'likely reflects subtler text or category patterns learned by the model'
  ELSE array_to_string(({REASONS})[1:3], '; ') END AS possible_reason_model_was_confused,"""
STUDY = ", ".join(f'"{c}"' for c in errors.STUDY_COLUMNS)


def sql_study(tag: str, where: str, order: str) -> str:
    return f"""(SELECT '{tag}' AS case_type, {STUDY}, label AS actual, predicted, round(score, 6) AS score_for_fake,
      substr(description, 1, 260) AS description_snippet FROM grouped WHERE {where} ORDER BY {order}, job_id LIMIT 25)"""


DISTANCE = "prediction_group, round(abs(score), 6) AS abs_score_distance_from_threshold,"


def sql_edited(profile: str, benefits: str, flag: str, zero: bool) -> str:
    counts = "0 AS company_profile_length, 0 AS benefits_length, 0 AS company_profile_word_count, 0 AS benefits_word_count"
    if not zero:
        counts = f"""length(company_profile) AS company_profile_length, length(benefits) AS benefits_length,
          {sql_words('company_profile')} AS company_profile_word_count, {sql_words('benefits')} AS benefits_word_count"""
    return f"""WITH {PREPARED}, edited AS (SELECT job_id, title, description, requirements,
        {profile} AS company_profile, {benefits} AS benefits FROM prepared)
      SELECT job_id, company_profile, benefits, {flag} AS has_company_logo, {flag} AS has_company_profile,
        {flag} AS has_benefits, {counts}, sha1({sql_combined()}) AS text_hash FROM edited"""


ORACLES = {
    "prediction_groups": f"WITH {SCORED} SELECT job_id, predicted, prediction_group FROM grouped",
    "error_counts": f"""WITH {SCORED} SELECT 'False positives' AS error_type, count(*) AS count FROM grouped WHERE {FP}
        UNION ALL SELECT 'False negatives', count(*) FROM grouped WHERE {FN}""",
    "error_profile": f"WITH {SCORED} SELECT prediction_group, count(*) AS count, "
    + ", ".join(f"round(avg({c}), 6) AS {n}" for c, n in PROFILE_MEANS.items()) + " FROM grouped GROUP BY prediction_group",
    "error_contrasts": f"WITH {SCORED}, m AS (" + union_columns(
        CONTRAST_FEATURES, lambda c: f"SELECT '{c}' AS feature, " + ", ".join(
            f"avg({c}) FILTER (prediction_group = '{name}') AS {short}" for short, name in GROUPS.items()
        ) + " FROM grouped"
    ) + """) SELECT feature, round(fp - tn, 6) AS false_positive_minus_true_negative,
        round(fn - tp, 6) AS false_negative_minus_true_positive, round(fp, 6) AS false_positive_rate,
        round(tn, 6) AS true_negative_rate, round(fn, 6) AS false_negative_rate, round(tp, 6) AS true_positive_rate FROM m""",
    "binary_error_rates": f"WITH {SCORED}, long AS (" + union_columns(
        BINARY, lambda c: f"SELECT '{c}' AS feature, {c} AS feature_value, label, predicted FROM grouped"
    ) + f") SELECT feature, feature_value, {ERROR_COLUMNS} FROM long GROUP BY feature, feature_value",
    "length_buckets": f"WITH {SCORED}{BUCKETS} SELECT job_id, text_field, length_bucket FROM bucketed",
    "length_bucket_error_rates": f"WITH {SCORED}{BUCKETS} SELECT text_field, length_bucket, {ERROR_COLUMNS} FROM bucketed GROUP BY ALL",
    "error_top_categories": f"WITH {SCORED}, long AS (" + union_columns(
        CATEGORIES, lambda c: f"SELECT prediction_group, '{c}' AS \"column\", \"{c}\" AS value FROM grouped"
    ) + """) SELECT prediction_group, "column", value, count(*) AS count,
        round(count(*) / (SELECT count(*) FROM grouped g WHERE g.prediction_group = long.prediction_group)::DOUBLE, 6) AS group_rate
        FROM long GROUP BY prediction_group, "column", value
        QUALIFY row_number() OVER (PARTITION BY prediction_group, "column" ORDER BY count(*) DESC, value) <= 5""",
    "subgroup_metrics": f"WITH {SCORED}, long AS (" + union_columns(
        SUBGROUP_FEATURES,
        lambda c: f"SELECT '{c}' AS feature, coalesce(nullif(\"{c}\"::VARCHAR, ''), 'missing') AS feature_value, label, predicted, score FROM grouped",
    ) + """) SELECT feature, feature_value, count(*) AS row_count, sum(label)::BIGINT AS fake_count,
        round(avg(label), 6) AS fake_rate, round(avg(predicted), 6) AS predicted_fake_rate,
        round(avg(label) FILTER (predicted = 1), 6) AS fake_precision, round(avg(predicted) FILTER (label = 1), 6) AS fake_recall,
        round(coalesce(2 * sum(label * predicted) / nullif(sum(label) + sum(predicted), 0)::DOUBLE, 0), 6) AS fake_f1,
        round(avg(predicted) FILTER (label = 0), 6) AS false_positive_rate_among_real,
        sum(label * predicted)::BIGINT AS true_positives, sum((1 - label) * predicted)::BIGINT AS false_positives,
        sum(label * (1 - predicted))::BIGINT AS false_negatives, sum((1 - label) * (1 - predicted))::BIGINT AS true_negatives,
        round(avg(score), 6) AS mean_score_for_fake FROM long GROUP BY ALL HAVING count(*) >= 50""",
    "score_summary": f"""WITH {SCORED} SELECT prediction_group, count(score) AS count, round(avg(score), 6) AS mean,
        round(median(score), 6) AS median, round(stddev_samp(score), 6) AS std, round(min(score), 6) AS min,
        round(max(score), 6) AS max FROM grouped GROUP BY prediction_group""",
    "false_positives": f"WITH {SCORED} {sql_cases(FP, 'score DESC', 10)}",
    "false_negatives": f"WITH {SCORED} {sql_cases(FN, 'score', 10)}",
    "top_false_positives": f"WITH {SCORED} {sql_cases(FP, 'score DESC', 25)}",
    "top_false_negatives": f"WITH {SCORED} {sql_cases(FN, 'score', 25)}",
    "borderline_cases": f"WITH {SCORED} {sql_cases('true', 'abs(score)', 20, DISTANCE)}",
    "least_confident_correct": f"WITH {SCORED} {sql_cases('label = predicted', 'abs(score)', 20, DISTANCE)}",
    "confident_mistakes": f"""WITH {SCORED} {sql_cases(FP, 'score DESC', 10, "'Most confident false positive' AS case_type,")}
        UNION ALL {sql_cases(FN, 'score', 10, "'Most confident false negative' AS case_type,")}""",
    "error_examples": f"""WITH {SCORED} {sql_cases(FP, 'score DESC', 6, "'False positive' AS error_type," + REASON, 260)}
        UNION ALL {sql_cases(FN, 'score', 6, "'False negative' AS error_type," + REASON, 260)}""",
    "error_cases": f"""WITH {SCORED} {sql_study('false_positive', FP, 'score DESC')}
        UNION ALL {sql_study('false_negative', FN, 'score')}""",
    "counterfactual_remove": sql_edited("''", "''", "0", True),
    "counterfactual_add": sql_edited(
        f"CASE WHEN has_company_profile = 0 THEN '{counterfactual.GENERIC_PROFILE}' ELSE company_profile END",
        f"CASE WHEN has_benefits = 0 THEN '{counterfactual.GENERIC_BENEFITS}' ELSE benefits END", "1", False,
    ),
    "low_score_examples": f"""WITH {SCORED} SELECT industry, job_id, round(score, 6) AS score,
        substr(combined_text, 1, 300) AS text_snippet FROM grouped
        QUALIFY row_number() OVER (PARTITION BY industry ORDER BY grouped.score, job_id) <= 5""",
}
