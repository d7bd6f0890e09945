"""Profiling a labelled table: one scan and map-side combined aggregates per report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpaudit.functions.numbers import count_if, percent_text, ratio
from corpaudit.functions.text import characters
from corpaudit.operators.ranks import order_statistics


def decode_label(label: Column) -> Column:
    return F.when(label == 1, "Fake").when(label == 0, "Real")


def long_form(
    df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "feature", value: str = "value",
    as_type: str = "string",
) -> DataFrame:
    """Wide to long, NULLs kept; every row becomes one row per column."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(c).cast(as_type).alias(value)) for c in columns]
    )
    return df.select(*keep, F.inline(pairs))


def dataset_summary(df: DataFrame, target: str, columns: int | None = None) -> DataFrame:
    """Rows, columns, class counts and rate per ``dataset``."""
    columns = len(df.columns) - 1 if columns is None else columns
    return df.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(columns).alias("columns"),
        count_if(F.col(target) == 0).alias("real_count"),
        count_if(F.col(target) == 1).alias("fake_count"),
        ratio(count_if(F.col(target) == 1), F.count(F.lit(1))).alias("fake_rate"),
    )


def majority_baseline(summary: DataFrame) -> DataFrame:
    """Accuracy of always predicting the larger class, as numbers' text in percent."""
    return summary.select(
        "dataset", "rows", "real_count", "fake_count",
        percent_text(F.col("fake_rate")).alias("fake_rate"),
        percent_text(1 - F.col("fake_rate")).alias("majority_class_accuracy"),
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(decode_label(F.col(target)).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    # The window sees one row per class.
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("label", "count", ratio(F.col("count"), total).alias("rate"))


def missing_rates(df: DataFrame, top: int = 15) -> DataFrame:
    """Share of NULLs per column, highest first, in one pass over the table."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return (
        long_form(rates, df.columns, name="column", value="missing_rate", as_type="double")
        .orderBy(F.desc("missing_rate"), "column")
        .limit(top)
    )


def length_summary(df: DataFrame, target: str, fields: Sequence[str]) -> DataFrame:
    """Mean, median and maximum characters per class and field."""
    lengths = df.select(
        decode_label(F.col(target)).alias("label"), *[characters(F.col(c)).alias(c) for c in fields]
    )
    long = long_form(lengths, fields, ["label"], "field", "characters", "long")
    # Few distinct lengths per group, so the exact median's value counts stay small.
    return long.groupBy("label", "field").agg(
        F.avg("characters").alias("mean"), F.median("characters").alias("median"), F.max("characters").alias("max")
    )


def category_rates(
    df: DataFrame, target: str, columns: Sequence[str], min_count: int = 30, top: int = 8
) -> DataFrame:
    """Positive rate of frequent category values, the highest ``top`` per column."""
    filled = df.select(
        F.col(target).alias("_target"), *[F.coalesce(F.col(c), F.lit("missing")).alias(c) for c in columns]
    )
    rates = (
        long_form(filled, columns, ["_target"], "column", "value")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("_target").alias("fake_rate"))
        .filter(F.col("count") >= min_count)
    )
    order = Window.partitionBy("column").orderBy(F.desc("fake_rate"), "value")
    return rates.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= top).drop("_place")


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and whiskers (last values within 1.5 interquartile ranges) per group."""
    quartiles = (
        order_statistics(df, value, [0.25, 0.5, 0.75], [group])
        .groupBy(group)
        .pivot("probability", [0.25, 0.5, 0.75])
        .agg(F.first("quantile"))
        .toDF(group, "q1", "median", "q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return (
        df.select(group, value)
        .join(quartiles, group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            count_if(~inside).alias("outliers"),
        )
    )


def score_histogram(
    df: DataFrame, group: str, value: str, low: float, high: float, bins: int
) -> DataFrame:
    """Equal-width histogram per group with density; values outside the range go to the end bins."""
    place = F.least(F.greatest(F.expr(f"width_bucket({value}, {low}D, {high}D, {bins})"), F.lit(1)), F.lit(bins))
    counts = df.groupBy(group, place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    # One row per group and bin from here on.
    width = (high - low) / bins
    total = F.sum("count").over(Window.partitionBy(group))
    return counts.select(
        group, "bin", "count",
        (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start"),
        (F.col("count") / (total * F.lit(width))).alias("density"),
    )
