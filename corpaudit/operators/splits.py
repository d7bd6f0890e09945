"""Train/test splits by seeded hash.

A split is a rule, not a list of rows: rows whose hash is at or below their stratum's cutoff are
test rows. The cutoffs are exact (see :func:`corpaudit.operators.ranks.rank_cutoffs`), there is one
per stratum, and applying them is a map over the rows: no shuffle, no join on row keys, the same
result after any retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpaudit.functions.hashing import seeded_hash
from corpaudit.functions.numbers import count_if, ratio
from corpaudit.operators.ranks import rank_cutoffs, value_at_share

TEST_SHARE = 0.25
SIDES = ("train", "test")


def _side(in_test: Column) -> Column:
    """A condition that can't be told (a NULL label has no cutoff) keeps the row in training."""
    return F.when(in_test, SIDES[1]).otherwise(SIDES[0])


def class_quotas(df: DataFrame, label: str, share: float = TEST_SHARE) -> DataFrame:
    """Test rows per class: ``ceil(share * n)`` in all, by largest remainder, ties to the smaller label."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    # One row per class.
    everything = Window.partitionBy()
    sized = counts.withColumn("_all", F.sum("_rows").over(everything)).withColumn(
        "_wanted", F.ceil(F.lit(share) * F.col("_all"))
    )
    fair = F.col("_rows") * F.col("_wanted") / F.col("_all")
    split = sized.withColumn("_floor", F.floor(fair)).withColumn("_rest", fair - F.floor(fair))
    short = F.col("_wanted") - F.sum("_floor").over(everything)
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("_rest"), label))
    return split.select(label, (F.col("_floor") + (place <= short).cast("long")).alias("_test_rows"))


def stratified_split(
    df: DataFrame, key: str, label: str, seeds: Sequence[int], share: float = TEST_SHARE
) -> DataFrame:
    """``df`` once per seed, with ``seed`` and ``part``: exact class sizes on both sides. Rows without a label train."""
    runs = df.withColumn("seed", _each(seeds))
    hashed = runs.withColumn("_hash", seeded_hash(F.col("seed"), F.col(key)))
    # One row per seed and class.
    marked = hashed.join(F.broadcast(class_cutoffs(df, key, label, seeds, share)), ["seed", label], "left")
    return marked.withColumn("part", _side(F.col("_hash") <= F.col("cutoff"))).select(*df.columns, "seed", "part")


def _each(seeds: Sequence[int]) -> Column:
    return F.explode(F.array(*[F.lit(int(s)) for s in seeds]))


def class_cutoffs(df: DataFrame, key: str, label: str, seeds: Sequence[int], share: float = TEST_SHARE) -> DataFrame:
    """``seed``, ``label``, ``cutoff``: the hash up to which a class's rows are test rows of that seed."""
    slim = df.filter(F.col(label).isNotNull()).select(label, F.col(key).alias("_key")).withColumn("seed", _each(seeds))
    hashed = slim.select("seed", label, seeded_hash(F.col("seed"), F.col("_key")).alias("_hash"))
    quotas = class_quotas(df, label, share).withColumn("seed", _each(seeds))
    return rank_cutoffs(hashed, ["seed", label], "_hash", F.col("_test_rows"), quotas)


def seed_marks(df: DataFrame, key: str, label: str, seeds: Sequence[int], names: Sequence[str], share: float = TEST_SHARE) -> DataFrame:
    """``df`` with a flag per seed (``names``, in the order of ``seeds``) for the test rows of its stratified split.

    The same sides as :func:`stratified_split`, without a copy of the rows for every seed.
    """
    cutoffs = class_cutoffs(df, key, label, seeds, share)
    # One row per class, an entry per seed.
    by_seed = F.map_from_entries(F.collect_list(F.struct("seed", "cutoff"))).alias("_cutoffs")
    per_class = cutoffs.groupBy(F.col(label).alias("_class")).agg(by_seed)
    marked = df.join(F.broadcast(per_class), F.col(label) == F.col("_class"), "left")
    sides = {
        name: F.coalesce(seeded_hash(int(seed), F.col(key)) <= F.try_element_at("_cutoffs", F.lit(int(seed))), F.lit(False))
        for name, seed in zip(names, seeds)
    }
    return marked.withColumns(sides).select(*df.columns, *names)


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 0 .. folds-1; within a class fold sizes differ by one row at most.

    Rows without a label get fold -1: no fold holds them out.
    """
    hashed = df.withColumn("_hash", seeded_hash(seed, F.col(key)))
    ends = F.col("_total")
    labelled = hashed.filter(F.col(label).isNotNull())
    inner = labelled.select(label, "_hash").withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(folds - 1)])))
    end_of_fold = (F.col("fold") + 1) * F.floor(ends / folds) + F.least(F.col("fold") + 1, ends % folds)
    cutoffs = rank_cutoffs(inner, [label, "fold"], "_hash", end_of_fold)
    # folds - 1 ends per class, one row per class
    per_class = cutoffs.groupBy(label).agg(F.collect_list("cutoff").alias("_ends"))
    passed = F.when(F.col(label).isNull(), -1).otherwise(
        F.coalesce(F.size(F.filter("_ends", lambda end: end < F.col("_hash"))), F.lit(0))
    )
    return hashed.join(F.broadcast(per_class), label, "left").withColumn("fold", passed).select(*df.columns, "fold")


def group_table(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows and positives per group, the only thing group splits are chosen from."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.col(label).cast("long")).alias("_pos"))


def group_cutoffs(
    groups: DataFrame, group: str, seed: int | Column, candidates: int = 1, share: float = TEST_SHARE,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per candidate the hash that sends exactly ``ceil(share * groups)`` groups to the test side."""
    hashed = _candidates(groups, group, seed, candidates)
    return rank_cutoffs(
        hashed.select(*by, "candidate", "_hash"), [*by, "candidate"], "_hash", F.ceil(F.lit(share) * F.col("_total"))
    )


def _candidates(groups: DataFrame, group: str, seed: int | Column, candidates: int) -> DataFrame:
    tried = groups.withColumn("candidate", F.explode(F.array(*[F.lit(i) for i in range(candidates)])))
    return tried.withColumn("_hash", seeded_hash(seed, F.col("candidate"), F.col(group)))


def best_candidate(
    groups: DataFrame, group: str, seed: int | Column, candidates: int, share: float = TEST_SHARE,
    by: Sequence[str] = (),
) -> DataFrame:
    """The candidate nearest to the overall positive rate and the wanted row share: one row per ``by``.

    Groups are never shuffled per candidate: each map task counts its groups per candidate, and the
    candidates' totals are added up. Both sides must hold positives.
    """
    by = list(by)
    cutoffs = group_cutoffs(groups, group, seed, candidates, share, by)
    hashed = _candidates(groups, group, seed, candidates)
    keys = [*by, "candidate"]
    in_test = F.col("_hash") <= F.col("cutoff")
    # One cutoff per candidate, a parameter of the call.
    totals = hashed.join(F.broadcast(cutoffs), keys).groupBy(*keys, "cutoff").agg(
        F.sum("_rows").alias("_all_rows"),
        F.sum("_pos").alias("_all_pos"),
        F.sum(F.when(in_test, F.col("_rows")).otherwise(0)).alias("test_rows"),
        F.sum(F.when(in_test, F.col("_pos")).otherwise(0)).alias("test_positives"),
    )
    gap = F.abs(F.col("test_positives") / F.col("test_rows") - F.col("_all_pos") / F.col("_all_rows")) + F.abs(
        F.col("test_rows") / F.col("_all_rows") - F.lit(share)
    )
    usable = totals.filter((F.col("test_positives") > 0) & (F.col("test_positives") < F.col("_all_pos")))
    chosen = F.min_by(
        F.struct("candidate", "cutoff", "test_rows", "test_positives", "_all_rows", "_all_pos", gap.alias("gap")),
        F.struct(gap, "candidate"),
    )
    best = usable.groupBy(*by).agg(chosen.alias("_best")).filter(F.col("_best").isNotNull())
    return best.select(*by, F.col("_best.*"))


def group_split(
    df: DataFrame, group: str, label: str, seed: int, candidates: int = 1, share: float = TEST_SHARE
) -> DataFrame:
    """``df`` with ``part``; no group is on both sides. With several candidates, the best of them.

    Raises if no candidate has positives on both sides. The driver gets the chosen cutoff, one row.
    """
    # Three passes read the groups; the texts behind their keys are read once.
    groups = group_table(df, group, label).persist()
    if candidates == 1:
        chosen = group_cutoffs(groups, group, seed, 1, share)
    else:
        chosen = best_candidate(groups, group, seed, candidates, share).select("candidate", "cutoff")
    best = chosen.first()
    empty = best is None and groups.isEmpty()
    groups.unpersist()
    if empty:
        return df.withColumn("part", F.lit(SIDES[0]))
    if best is None:
        raise ValueError(f"none of {candidates} splits by {group} has positives of {label} on both sides")
    hashed = seeded_hash(seed, F.lit(best["candidate"]), F.col(group))
    return df.withColumn("part", _side(hashed <= F.lit(best["cutoff"])))


def order_split(df: DataFrame, key: str, train_share: float = 1 - TEST_SHARE) -> DataFrame:
    """The first rows by key train, the rest test; unique keys, ``round_half_even(share * n)`` rows train."""
    cutoff = value_at_share(df, key, train_share)
    # One row.
    marked = df.crossJoin(F.broadcast(cutoff))
    return marked.withColumn("part", _side(F.col(key) > F.col("cutoff"))).select(*df.columns, "part")


# The split protocols of the leakage study.
PROTOCOLS = ("random_stratified", "exact_duplicate_group", "near_template_group_098")


def split_by_protocol(
    df: DataFrame, protocol: str, seed: int, key: str, label: str,
    exact_group: str = "exact_signature", near_group: str = "near_template_cluster_098", candidates: int = 30,
) -> DataFrame:
    if protocol == PROTOCOLS[0]:
        return stratified_split(df, key, label, [seed]).drop("seed")
    if protocol == PROTOCOLS[1]:
        return group_split(df, exact_group, label, seed, candidates)
    if protocol == PROTOCOLS[2]:
        return group_split(df, near_group, label, seed, candidates)
    raise ValueError(f"Unknown split protocol: {protocol}")


def split_stats(parts: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positive rate of both sides, positives of the test side."""
    test = F.col("part") == SIDES[1]
    positive = F.col(label) == 1
    return parts.groupBy(*by).agg(
        count_if(~test).alias("train_rows"),
        count_if(test).alias("test_rows"),
        ratio(count_if(~test & positive), count_if(~test)).alias("train_fake_rate"),
        ratio(count_if(test & positive), count_if(test)).alias("test_fake_rate"),
        count_if(test & positive).alias("test_fake_count"),
    )
