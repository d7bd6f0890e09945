"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpaudit.operators.duplicates import cluster_summary, leakage
from corpaudit.session import checkpointed


def _large_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node it can see."""
    both = edges.unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter(F.col("v") > F.col("u")).join(smallest, [*by, "u"])
    return larger.select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, by: list[str]) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges point downwards."""
    smallest = edges.groupBy(*by, "u").agg(F.min("v").alias("m"))
    siblings = edges.join(smallest, [*by, "u"]).filter(F.col("v") != F.col("m"))
    linked = siblings.select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(smallest.select(*by, "u", F.col("m").alias("v"))).distinct()


def _fingerprint(edges: DataFrame, by: list[str]):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, by: Sequence[str] = (), max_rounds: int = 100) -> DataFrame:
    """``by``, ``node``, ``cluster`` for every node with an edge; the cluster is its smallest node.

    ``edges`` has columns ``u``, ``v``; graphs told apart by ``by`` are solved in the same rounds. A
    round costs two joins on the edge list; the number of rounds grows with the logarithm of the
    longest path. Each round is checkpointed, and the driver sees only a fingerprint of the edges.
    The joins meet one row per node, so a hub's edges can be split by adaptive skew handling.
    """
    by = list(by)
    downwards = edges.filter(F.col("u") != F.col("v")).select(
        *by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    current = checkpointed(downwards.distinct())
    before = _fingerprint(current, by)
    for _ in range(max_rounds):
        current = checkpointed(_small_star(_large_star(current, by), by))
        after = _fingerprint(current, by)
        if after == before:
            members = current.select(*by, F.col("u").alias("node"), F.col("v").alias("cluster"))
            roots = current.select(*by, F.col("v").alias("node"), F.col("v").alias("cluster")).distinct()
            return members.unionByName(roots)
        before = after
    raise RuntimeError(f"no stable components after {max_rounds} rounds")


def clusters(nodes: DataFrame, key: str, pairs: DataFrame, threshold: float, name: str = "cluster") -> DataFrame:
    """``nodes`` with the cluster of each row under pairs at or above the threshold; singletons keep their own key."""
    swept = clusters_at(nodes, key, pairs, [threshold], name)
    return swept.drop("similarity_threshold")


def clusters_at(
    nodes: DataFrame, key: str, pairs: DataFrame, thresholds: Sequence[float], name: str = "cluster"
) -> DataFrame:
    """``nodes`` once per ``similarity_threshold`` with its cluster there; all thresholds in the same rounds."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    by = ["similarity_threshold"]
    edges = pairs.select(
        F.col("row_a").alias("u"), F.col("row_b").alias("v"),
        F.explode(F.filter(levels, lambda t: F.col("cosine_similarity") >= t)).alias(by[0]),
    )
    labels = connected_components(edges, by).select(*by, F.col("node").alias(key), F.col("cluster").alias("_cluster"))
    repeated = nodes.withColumn(by[0], F.explode(levels))
    return repeated.join(labels, [*by, key], "left").withColumn(name, F.coalesce("_cluster", F.col(key))).drop("_cluster")


def threshold_sweep(
    parts: DataFrame, key: str, target: str, pairs: DataFrame, thresholds: Sequence[float] = (0.95, 0.98, 0.99)
) -> DataFrame:
    """Cluster summary and train-test leakage per threshold. ``parts`` carries ``part``."""
    by = ["similarity_threshold"]
    labelled = clusters_at(parts, key, pairs, thresholds)
    return cluster_summary(labelled, "cluster", target, by).join(leakage(labelled, "cluster", by), by)
