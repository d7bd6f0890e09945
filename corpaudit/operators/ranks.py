"""Exact global order statistics without a global sort in one task.

Two ways to cut an order into buckets that are ranked side by side:

* by value: cut points from ``approxQuantile`` (:func:`prefix_sums`, :func:`order_statistics`).
  The cut points only balance the work; results are exact for any cut points.
* by seeded hash: the first hex digits (:func:`rank_cutoffs`, :func:`numbered`).

In both, equal values are first counted together with a map-side combine, so one value that holds
most of the rows costs one row; the running totals over buckets see one row per bucket.
Columns named in ``by`` must not be NULL.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpaudit.functions.hashing import hash_bucket
from corpaudit.session import parallelism

MAX_BUCKETS = 2048


def value_buckets(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Cut points that split the values into about equal parts."""
    buckets = buckets or min(MAX_BUCKETS, max(16, 2 * parallelism(df.sparkSession)))
    probabilities = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(column, probabilities, 0.5 / buckets)
    return sorted(set(found or []))


def with_bucket(df: DataFrame, column: str, cuts: Sequence[float]) -> DataFrame:
    """Adds ``_bucket``, growing with the value."""
    if not cuts:
        return df.withColumn("_bucket", F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    keyed = df.withColumn("_value", F.col(column).cast("double"))
    bucketizer = Bucketizer(splits=splits, inputCol="_value", outputCol="_bucket", handleInvalid="keep")
    return bucketizer.transform(keyed).drop("_value")


def prefix_sums(
    scores: DataFrame,
    by: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """One row per distinct score: its rows and positives, and both accumulated from the top.

    Columns: ``by``, score, ``n``, ``pos``, ``cum_n``, ``cum_pos`` (rows at or above the score),
    ``total_n``, ``total_pos``.
    """
    by = list(by)
    scores = scores.select(*by, F.col(score).cast("double").alias(score), label)
    cuts = value_buckets(scores, score) if cuts is None else cuts
    # Rows without a label are neither positives nor negatives.
    distinct = scores.filter(F.col(label).isNotNull()).groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    bucketed = with_bucket(distinct, score, cuts)
    keys = [*by, "_bucket"]
    per_bucket = bucketed.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    above = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *keys,
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above_n"),
        F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_above_pos"),
        F.sum("_n").over(whole).alias("total_n"),
        F.sum("_pos").over(whole).alias("total_pos"),
    )
    inside = (
        Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        bucketed.join(offsets, keys)
        .select(
            *by, score, "n", "pos",
            (F.sum("n").over(inside) + F.col("_above_n")).alias("cum_n"),
            (F.sum("pos").over(inside) + F.col("_above_pos")).alias("cum_pos"),
            "total_n", "total_pos",
        )
    )


def _lookup(
    df: DataFrame, column: str, positions: Column, by: list[str], cuts: Sequence[float] | None
) -> DataFrame:
    """The values on both sides of each wanted place: ``by``, ``probability``, ``low``, ``high``, ``share``.

    ``positions`` is an array of ``(probability, at)`` over the group's ``_total``, with zero-based
    places. Each place is looked up in the one bucket that holds it.
    """
    values = df.select(*by, column).filter(F.col(column).isNotNull())
    cuts = value_buckets(values, column) if cuts is None else cuts
    counted = with_bucket(values.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n")), column, cuts)
    keys = [*by, "_bucket"]
    below = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        counted.groupBy(*keys)
        .agg(F.sum("n").alias("_n"))
        .select(
            *keys, "_n",
            F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_from"),
            F.sum("_n").over(Window.partitionBy(*by)).alias("_total"),
        )
        .withColumn("_positions", positions)
        .withColumn(
            "_wanted",
            F.filter(
                "_positions",
                lambda p: (F.ceil(p["at"]) >= F.col("_from")) & (F.floor(p["at"]) < F.col("_from") + F.col("_n")),
            ),
        )
        .filter(F.size("_wanted") > 0)
        .select(*keys, "_from", "_wanted")
    )
    inside = (
        Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Each value now knows which zero-based places [_first, _next) it fills.
    placed = (
        counted.join(wanted, keys)
        .withColumn("_next", F.sum("n").over(inside) + F.col("_from"))
        .withColumn("_first", F.col("_next") - F.col("n"))
        .withColumn(
            "_wanted",
            F.filter(
                "_wanted",
                lambda p: (F.ceil(p["at"]) >= F.col("_first")) & (F.floor(p["at"]) < F.col("_next")),
            ),
        )
        .filter(F.size("_wanted") > 0)
        .select(*by, column, "_first", "_next", F.explode("_wanted").alias("_p"))
    )
    at = F.col("_p.at")

    def value_in(place: Column) -> Column:
        return F.max(F.when((place >= F.col("_first")) & (place < F.col("_next")), F.col(column)))

    return placed.groupBy(*by, F.col("_p.probability").alias("probability")).agg(
        value_in(F.floor(at)).alias("low"),
        value_in(F.ceil(at)).alias("high"),
        F.max(at - F.floor(at)).alias("share"),
    )


def order_statistics(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles: ``by``, ``probability``, ``quantile``; NULLs left out."""
    by = list(by)
    # One literal array, however many probabilities.
    listed = F.from_json(F.lit(json.dumps([float(p) for p in probabilities])), "array<double>")
    positions = F.transform(
        listed, lambda p: F.struct(p.alias("probability"), (p * (F.col("_total") - 1)).alias("at"))
    )
    return _lookup(df, column, positions, by, cuts).select(
        *by, "probability", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("quantile")
    )


def value_at_share(df: DataFrame, column: str, share: float, name: str = "cutoff") -> DataFrame:
    """One row: the value at rank ``round_half_even(share * n)`` from below, in the column's own type."""
    place = F.greatest(F.bround(F.lit(float(share)) * F.col("_total"), 0) - 1, F.lit(0.0)).cast("double")
    positions = F.array(F.struct(F.lit(float(share)).alias("probability"), place.alias("at")))
    return _lookup(df, column, positions, [], None).select(F.col("low").alias(name))


def quantile_values(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """The quantiles as driver values, in the order asked for; one number per probability."""
    rows = order_statistics(df, column, sorted(set(probabilities))).collect()
    found = {row["probability"]: row["quantile"] for row in rows}
    return [found[float(p)] for p in probabilities]


def bucket_bounds(df: DataFrame, strata: Sequence[str], hashed: str) -> DataFrame:
    """Ranks covered by each hash bucket of a stratum: ``(_from, _to]`` and the stratum's ``_total``."""
    strata = list(strata)
    so_far = (
        Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        df.select(*strata, hash_bucket(F.col(hashed)).alias("_bucket"))
        .groupBy(*strata, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *strata, "_bucket",
            F.sum("_n").over(so_far).alias("_to"),
            (F.sum("_n").over(so_far) - F.col("_n")).alias("_from"),
            F.sum("_n").over(Window.partitionBy(*strata)).alias("_total"),
        )
    )


def rank_cutoffs(
    df: DataFrame, strata: Sequence[str], hashed: str, quota: Column, extra: DataFrame | None = None
) -> DataFrame:
    """The hash that is exactly the ``quota``-th smallest of its stratum: strata, ``cutoff``.

    Taking rows with ``hash <= cutoff`` then selects exactly ``quota`` rows without ranking,
    shuffling or joining the rows themselves. ``quota`` may use ``_total`` and the columns of
    ``extra`` (one row per stratum). Only the bucket that contains the quota is sorted. A stratum
    with quota 0 gets the cutoff ''.
    """
    strata = list(strata)
    bounds = bucket_bounds(df, strata, hashed)
    if extra is not None:
        bounds = bounds.join(F.broadcast(extra), strata) if strata else bounds.crossJoin(F.broadcast(extra))
    bounds = bounds.withColumn("_quota", F.least(quota.cast("long"), F.col("_total")))
    boundary = bounds.filter((F.col("_from") < F.col("_quota")) & (F.col("_quota") <= F.col("_to")))
    boundary = boundary.select(*strata, "_bucket", (F.col("_quota") - F.col("_from")).alias("_place"))
    nothing = bounds.filter(F.col("_quota") <= 0).select(*strata, F.lit("").alias("cutoff")).distinct()
    in_bucket = df.select(*strata, hashed, hash_bucket(F.col(hashed)).alias("_bucket")).join(
        F.broadcast(boundary), [*strata, "_bucket"]
    )
    order = Window.partitionBy(*strata, "_bucket").orderBy(hashed)
    exact = (
        in_bucket.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == F.col("_place"))
        .select(*strata, F.col(hashed).alias("cutoff"))
    )
    return exact.unionByName(nothing)


def numbered(df: DataFrame, strata: Sequence[str], hashed: str, position: str = "position") -> DataFrame:
    """Rows of each stratum numbered 0, 1, 2 ... in hash order: one shuffle into balanced buckets."""
    strata = list(strata)
    keys = [*strata, "_bucket"]
    bounds = bucket_bounds(df, strata, hashed).select(*keys, "_from")
    order = Window.partitionBy(*keys).orderBy(hashed)
    return (
        df.withColumn("_bucket", hash_bucket(F.col(hashed)))
        .join(bounds, keys)
        .withColumn(position, F.row_number().over(order) - 1 + F.col("_from"))
        .drop("_bucket", "_from")
    )
