"""One maximum spanning forest for every similarity threshold.

Rows are connected at a threshold through pairs at or above it exactly when they are in the forest. It is built by
contraction: a row's strongest pair always belongs to it, and below that pair's similarity the row is one with its partner,
so the row is replaced by the partner in all its other pairs. A round removes a good part of the rows; which of two
partners goes is settled by a hash, so that the number of rounds grows with the logarithm of the rows. What is left over is
a tree of at most one row per row, whose paths tell the clusters at any threshold without another look at the pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from corpaudit.operators.duplicates import cluster_summary, leakage
from corpaudit.session import stored

#: Links of a chain of rows that a round follows at most, as a power of two; longer chains go on in the next round.
JUMPS = 3
_PATH = "array<struct<top:bigint,weight:double>>"


@dataclass(frozen=True)
class SpanningForest:
    """``tree``: ``node``, ``up``, ``weight`` and the pair ``row_a``, ``row_b`` it stands for; a row per forest edge."""

    tree: DataFrame

    def pairs(self) -> DataFrame:
        """The forest's pairs, each of them one of those it was built from."""
        return self.tree.select("row_a", "row_b", F.col("weight").alias("cosine_similarity"))

    def paths(self, max_rounds: int = 60) -> DataFrame:
        """``node``, ``path``: the rows above it, nearest first, each with the weakest similarity on the way there. Paths
        double in length with every round."""
        step = F.array(F.struct(F.col("up").alias("top"), "weight"))
        current = stored(self.tree.select("node", step.alias("path"), F.lit(True).alias("open")))
        for _ in range(max_rounds):
            if current.filter("open").isEmpty():
                return current.select("node", "path")
            last = F.element_at("path", -1)
            above = current.select(F.col("node").alias("_top"), F.col("path").alias("_more"))
            joined = current.withColumn("_top", last["top"]).join(above, "_top", "left")
            more = F.transform("_more", lambda p: F.struct(p["top"].alias("top"), F.least(p["weight"], last["weight"]).alias("weight")))
            current = stored(joined.select(
                "node", F.concat("path", F.coalesce(more, F.array().cast(_PATH))).alias("path"), F.col("_more").isNotNull().alias("open")))
        raise RuntimeError(f"paths still grow after {max_rounds} rounds")

    def clusters_at(self, nodes: DataFrame, key: str, thresholds: Sequence[float], name: str = "cluster") -> DataFrame:
        """``nodes`` once per ``similarity_threshold`` with the smallest key of their cluster there."""
        by = "similarity_threshold"
        levels = F.array(*[F.lit(float(t)) for t in thresholds])
        # The topmost row reached: the weights along a path only fall.
        at = lambda t: F.element_at(F.filter("path", lambda p: p["weight"] >= t), -1)["top"]
        tops = F.transform(levels, lambda t: F.struct(t.alias(by), F.when(F.exists("path", lambda p: p["weight"] >= t), at(t)).alias("top")))
        placed = self.paths().select("node", F.inline(tops)).filter("top IS NOT NULL")
        smallest = placed.groupBy(by, "top").agg(F.least(F.min("node"), F.col("top")).alias("_cluster"))
        labels = placed.join(smallest, [by, "top"]).select(by, F.col("node").alias(key), "_cluster").unionByName(
            smallest.select(by, F.col("top").alias(key), "_cluster"))
        repeated = nodes.withColumn(by, F.explode(levels))
        return repeated.join(labels, [by, key], "left").withColumn(name, F.coalesce("_cluster", F.col(key))).drop("_cluster")


def _slim(edges: DataFrame) -> DataFrame:
    """The strongest of the edges between two nodes, ``u`` < ``v``."""
    return edges.filter("u != v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(
        F.max(F.struct("weight", "row_a", "row_b")).alias("best")).select("u", "v", "best.*")


def spanning_forest(pairs: DataFrame, max_rounds: int = 200) -> SpanningForest:
    """The maximum spanning forest of ``row_a``, ``row_b``, ``cosine_similarity``; equal similarities are told apart by the
    rows, so the forest is one and the same whatever the partitioning. A round's rows are a table."""
    named = pairs.filter("row_a IS NOT NULL AND row_b IS NOT NULL").select(
        F.col("row_a").cast("long").alias("u"), F.col("row_b").cast("long").alias("v"),
        F.col("cosine_similarity").cast("double").alias("weight"), F.least("row_a", "row_b").cast("long").alias("row_a"),
        F.greatest("row_a", "row_b").cast("long").alias("row_b"),
    )
    edges, parts = stored(_slim(named)), []
    schema = "node long, up long, weight double, row_a long, row_b long"
    for turn in range(max_rounds):
        if edges.isEmpty():
            tree = reduce(DataFrame.unionByName, parts) if parts else edges.sparkSession.createDataFrame([], schema)
            return SpanningForest(tree)
        ends = lambda one, two: edges.select(F.col(one).alias("node"), F.struct("weight", "row_a", "row_b", F.col(two).alias("up")).alias("best"))
        best = ends("u", "v").unionByName(ends("v", "u")).groupBy("node").agg(F.max("best").alias("best")).select("node", "best.*")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))
        gone = stored(best.filter(rank("up") < rank("node")).select("node", "up", "weight", "row_a", "row_b"))
        moved = gone.select("node", "up")
        for _ in range(JUMPS):
            further = moved.select(F.col("node").alias("up"), F.col("up").alias("_further"))
            moved = moved.join(further, "up", "left").select("node", F.coalesce("_further", "up").alias("up"))
        moved = stored(moved)
        # A chain longer than the jumps: its rows stay for the next round.
        done = moved.join(gone.select(F.col("node").alias("up")), "up", "left_anti").select("node", "up")
        parts.append(stored(gone.join(done.select("node"), "node", "left_semi")))
        for side in ("u", "v"):
            target = done.select(F.col("node").alias(side), F.col("up").alias("_to"))
            edges = edges.join(target, side, "left").withColumn(side, F.coalesce("_to", F.col(side))).drop("_to")
        edges = stored(_slim(edges))
    raise RuntimeError(f"pairs left after {max_rounds} rounds")


def forest_sweep(
    parts: DataFrame, key: str, target: str, pairs: DataFrame, thresholds: Sequence[float]
) -> DataFrame:
    """Cluster summary and train-test leakage per threshold, all from one forest. ``parts`` carries ``part``."""
    by = ["similarity_threshold"]
    labelled = stored(spanning_forest(pairs).clusters_at(parts, key, thresholds))
    return cluster_summary(labelled, "cluster", target, by).join(leakage(labelled, "cluster", by), by)
