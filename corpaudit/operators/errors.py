"""Error slices and case exports on a scored table (``label``, ``score`` and posting columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpaudit.functions.numbers import count_if, mean_if, ratio
from corpaudit.functions.text import normalise, or_default, snippet
from corpaudit.operators.metrics import group_metrics
from corpaudit.operators.profile import decode_label, long_form
from corpaudit.operators.ranks import order_statistics

# Names of the prediction groups in the two report styles.
GROUPS = ("True positive", "False negative", "False positive", "True negative")
HOLDOUT_GROUPS = (
    "true_positive_fake_detected", "false_negative_fake_missed",
    "false_positive_real_flagged", "true_negative_real_kept",
)
ERROR_GROUPS = (GROUPS[2], GROUPS[1])

# The terms and sentences of the reason rules.
SUSPICIOUS_TERMS = ("money", "earn", "link", "click", "home", "remote")
REASON_TERMS = "contains terms that may resemble scam or remote-work language"
REASON_NO_PROFILE = "missing company profile"
REASON_NO_REQUIREMENTS = "missing requirements text"
REASON_SHORT = "short description"
REASON_NO_LOGO = "no company logo"
REASON_OTHER = "likely reflects subtler text or category patterns learned by the model"
SHORT_DESCRIPTION = 400


def prediction_group(label: Column, predicted: Column, names: Sequence[str] = GROUPS) -> Column:
    tp, fn, fp, tn = names
    return (
        F.when((label == 1) & (predicted == 1), tp)
        .when((label == 1) & (predicted == 0), fn)
        .when((label == 0) & (predicted == 1), fp)
        .otherwise(tn)
    )


def with_groups(scored: DataFrame, threshold: float = 0.0, names: Sequence[str] = GROUPS) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.withColumn("predicted", predicted).withColumn(
        "prediction_group", prediction_group(F.col("label"), predicted, names)
    )


def error_reasons(most: int = 3) -> Column:
    """Why a model may have been confused: the first rules that hold, joined by '; '."""
    title, description = F.col("title"), F.col("description")
    text = F.lower(F.concat_ws(" ", or_default(title), or_default(description)))
    suspicious = text.rlike("|".join(SUSPICIOUS_TERMS))
    blank = lambda c: normalise(c) == ""
    rules = F.array_compact(
        F.array(
            F.when(suspicious, REASON_TERMS),
            F.when(blank(F.col("company_profile")), REASON_NO_PROFILE),
            F.when(blank(F.col("requirements")), REASON_NO_REQUIREMENTS),
            F.when(F.length(or_default(description)) < SHORT_DESCRIPTION, REASON_SHORT),
            F.when(F.col("has_company_logo") == 0, REASON_NO_LOGO),
        )
    )
    return F.when(F.size(rules) == 0, REASON_OTHER).otherwise(F.array_join(F.slice(rules, 1, most), "; "))


def error_counts(grouped: DataFrame) -> DataFrame:
    counts = grouped.agg(
        count_if(F.col("prediction_group") == GROUPS[2]).alias("_fp"),
        count_if(F.col("prediction_group") == GROUPS[1]).alias("_fn"),
    )
    return counts.select(
        F.inline(
            F.array(
                F.struct(F.lit("False positives").alias("error_type"), F.col("_fp").alias("count")),
                F.struct(F.lit("False negatives").alias("error_type"), F.col("_fn").alias("count")),
            )
        )
    )


def error_profile(grouped: DataFrame, means: dict[str, str]) -> DataFrame:
    """Row count and mean of each column per prediction group; ``means`` maps column to output name."""
    return grouped.groupBy("prediction_group").agg(
        F.count(F.lit(1)).alias("count"), *[F.avg(column).alias(name) for column, name in means.items()]
    )


def error_contrasts(grouped: DataFrame, features: Sequence[str], names: Sequence[str] = GROUPS) -> DataFrame:
    """Feature means of mistakes against the right decisions they are mistaken for."""
    tp, fn, fp, tn = names
    group = F.col("prediction_group")
    long = long_form(grouped, features, ["prediction_group"], "feature", "value", "double")
    means = long.groupBy("feature").agg(
        mean_if(F.col("value"), group == fp).alias("false_positive_rate"),
        mean_if(F.col("value"), group == tn).alias("true_negative_rate"),
        mean_if(F.col("value"), group == fn).alias("false_negative_rate"),
        mean_if(F.col("value"), group == tp).alias("true_positive_rate"),
    )
    return means.select(
        "feature",
        (F.col("false_positive_rate") - F.col("true_negative_rate")).alias("false_positive_minus_true_negative"),
        (F.col("false_negative_rate") - F.col("true_positive_rate")).alias("false_negative_minus_true_positive"),
        "false_positive_rate", "true_negative_rate", "false_negative_rate", "true_positive_rate",
    )


def _error_rates(long: DataFrame, by: Sequence[str]) -> DataFrame:
    real, fake = F.col("label") == 0, F.col("label") == 1
    counts = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        count_if(real).alias("real_count"),
        count_if(fake).alias("fake_count"),
        count_if(real & (F.col("predicted") == 1)).alias("false_positive_count"),
        count_if(fake & (F.col("predicted") == 0)).alias("false_negative_count"),
    )
    return counts.select(
        *by, "row_count", "real_count", "fake_count", "false_positive_count",
        ratio(F.col("false_positive_count"), F.col("real_count")).alias("false_positive_rate_among_real"),
        "false_negative_count",
        ratio(F.col("false_negative_count"), F.col("fake_count")).alias("false_negative_rate_among_fake"),
    )


def binary_error_rates(grouped: DataFrame, features: Sequence[str]) -> DataFrame:
    """False positive and false negative rate per value of each 0/1 feature."""
    long = long_form(grouped, features, ["label", "predicted"], "feature", "feature_value", "int")
    return _error_rates(long.filter(F.col("feature_value").isNotNull()), ["feature", "feature_value"])


def length_edges(lengths: DataFrame, fields: Sequence[str], buckets: int = 5) -> dict[str, list[float]]:
    """Distinct quantile edges per field, at most ``buckets + 1`` numbers each."""
    long = long_form(lengths, fields, [], "text_field", "characters", "double")
    rows = order_statistics(long, "characters", [i / buckets for i in range(buckets + 1)], ["text_field"]).collect()
    return {field: sorted({r["quantile"] for r in rows if r["text_field"] == field}) for field in fields}


def bucket_of(value: Column, edges: Sequence[float]) -> Column:
    """Right-closed quantile bucket (0 first), the lowest edge included; NULL without two edges."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    place = F.lit(0)
    for edge in edges[1:-1]:
        place = place + (value > F.lit(edge)).cast("int")
    return place


def length_buckets(df: DataFrame, fields: Sequence[str], keep: Sequence[str], buckets: int = 5) -> DataFrame:
    """Long form of the length columns with their quantile bucket."""
    edges = length_edges(df, fields, buckets)
    entries = F.array(
        *[
            F.struct(
                F.lit(field).alias("text_field"),
                F.col(field).cast("double").alias("characters"),
                bucket_of(F.col(field), edges[field]).alias("length_bucket"),
            )
            for field in fields
        ]
    )
    return df.select(*keep, F.inline(entries)).filter(F.col("length_bucket").isNotNull())


def length_bucket_error_rates(grouped: DataFrame, fields: Sequence[str], buckets: int = 5) -> DataFrame:
    long = length_buckets(grouped, fields, ["label", "predicted"], buckets)
    return _error_rates(long, ["text_field", "length_bucket"])


def top_categories(grouped: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """Most frequent category values of every prediction group and their share of the group."""
    filled = grouped.select("prediction_group", *[F.coalesce(F.col(c), F.lit("missing")).alias(c) for c in columns])
    counts = (
        long_form(filled, columns, ["prediction_group"], "column", "value")
        .groupBy("prediction_group", "column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # Counts per value: each column's counts add up to the size of the group.
    keys = ["prediction_group", "column"]
    size = counts.groupBy(*keys).agg(F.sum("count").alias("_size"))
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "value")
    first = counts.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= top)
    return first.join(size, keys).select(
        *keys, "value", "count", ratio(F.col("count"), F.col("_size")).alias("group_rate")
    )


def subgroup_metrics(
    scored: DataFrame, features: Sequence[str], min_rows: int = 50, threshold: float = 0.0
) -> DataFrame:
    """Metrics of every frequent value of every slice column; NULL and '' are one value, 'missing'."""
    named = scored.select(
        "label", "score",
        *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("missing")).alias(c) for c in features],
    )
    long = long_form(named, features, ["label", "score"], "feature", "feature_value")
    return group_metrics(long, ["feature", "feature_value"], threshold, min_rows)


def score_summary(grouped: DataFrame, group: str = "prediction_group", score: str = "score") -> DataFrame:
    """Count, mean, exact median, sample deviation, minimum and maximum per group."""
    middle = order_statistics(grouped, score, [0.5], [group]).select(group, F.col("quantile").alias("median"))
    plain = grouped.groupBy(group).agg(
        F.count(score).alias("count"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"), F.max(score).alias("max"),
    )
    return plain.join(middle, group).select(group, "count", "mean", "median", "std", "min", "max")


# The columns of the case tables.
CASE_COLUMNS = (
    "job_id", "title", "location", "employment_type", "required_experience", "industry", "function",
)
STUDY_COLUMNS = (
    "job_id", "title", "location", "employment_type", "required_experience", "industry", "function",
    "has_company_logo", "has_company_profile", "has_benefits",
    "description_length", "company_profile_length", "benefits_length",
)


def _case_columns(snippet_size: int = 240) -> list[Column]:
    return [
        *[F.col(c) for c in CASE_COLUMNS],
        decode_label(F.col("label")).alias("actual_label"),
        decode_label(F.col("predicted")).alias("predicted_label"),
        F.col("score").alias("model_score_for_fake"),
        snippet(F.col("description"), snippet_size).alias("description_snippet"),
    ]


def false_positives(grouped: DataFrame, top: int = 10, key: str = "job_id") -> DataFrame:
    """Negatives with the highest scores among those flagged."""
    wrong = grouped.filter((F.col("label") == 0) & (F.col("predicted") == 1))
    return wrong.orderBy(F.desc("score"), key).limit(top).select(*_case_columns())


def false_negatives(grouped: DataFrame, top: int = 10, key: str = "job_id") -> DataFrame:
    """Positives with the lowest scores among those let through."""
    wrong = grouped.filter((F.col("label") == 1) & (F.col("predicted") == 0))
    return wrong.orderBy("score", key).limit(top).select(*_case_columns())


def confident_mistakes(grouped: DataFrame, top: int = 10) -> DataFrame:
    alarms = false_positives(grouped, top).withColumn("case_type", F.lit("Most confident false positive"))
    misses = false_negatives(grouped, top).withColumn("case_type", F.lit("Most confident false negative"))
    return alarms.unionByName(misses)


def borderline_cases(grouped: DataFrame, top: int = 20, key: str = "job_id", only_correct: bool = False) -> DataFrame:
    """Cases nearest to the threshold 0, of all rows or of the right decisions."""
    if only_correct:
        grouped = grouped.filter(F.col("prediction_group").isin(GROUPS[0], GROUPS[3]))
    distance = F.abs(F.col("score"))
    return (
        grouped.withColumn("abs_score_distance_from_threshold", distance)
        .orderBy("abs_score_distance_from_threshold", key)
        .limit(top)
        .select(*_case_columns(), "prediction_group", "abs_score_distance_from_threshold")
    )


def error_examples(grouped: DataFrame, top: int = 6, key: str = "job_id") -> DataFrame:
    """The clearest mistakes of both kinds with the reasons the rules give."""
    shown = [*_case_columns(260), error_reasons().alias("possible_reason_model_was_confused")]
    alarms = grouped.filter(F.col("prediction_group") == GROUPS[2]).orderBy(F.desc("score"), key).limit(top)
    misses = grouped.filter(F.col("prediction_group") == GROUPS[1]).orderBy("score", key).limit(top)
    return alarms.select(F.lit(GROUPS[2]).alias("error_type"), *shown).unionByName(
        misses.select(F.lit(GROUPS[1]).alias("error_type"), *shown)
    )


def error_cases(scored: DataFrame, top: int = 25, key: str = "job_id") -> DataFrame:
    """Case studies of the strongest mistakes of both kinds, tagged."""
    predicted = (F.col("score") >= 0).cast("int")
    cases = scored.withColumn("predicted", predicted)
    shown = [
        *[F.col(c) for c in STUDY_COLUMNS], F.col("label").alias("actual"), F.col("predicted"),
        F.col("score").alias("score_for_fake"), snippet(F.col("description"), 260, False).alias("description_snippet"),
    ]
    alarms = cases.filter((F.col("label") == 0) & (F.col("predicted") == 1)).orderBy(F.desc("score"), key).limit(top)
    misses = cases.filter((F.col("label") == 1) & (F.col("predicted") == 0)).orderBy("score", key).limit(top)
    return alarms.select(F.lit("false_positive").alias("case_type"), *shown).unionByName(
        misses.select(F.lit("false_negative").alias("case_type"), *shown)
    )
