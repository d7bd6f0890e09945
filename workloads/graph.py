"""Neighbour pairs, clusters and near-duplicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpaudit.operators import allpairs, components, duplicates, forest, neighbours, splits
from corpaudit.operators.textfeatures import TfIdf
from corpaudit.operators.topics import svd_embedding
from corpaudit.plans import studies
from corpaudit.session import spread
from workloads.corpus import VOCABULARY
from workloads.sampling import SEED, sql_hash
from workloads.views import postings, rounded, table

K = 7
# The driver's vectors are spread out: similarities as high as in repeated postings do not occur.
CLUSTER, SWEEP, BAND = 0.38, (0.36, 0.38, 0.42), (0.36, 0.45)
FOREST_SWEEP = tuple(round(0.36 + 0.005 * i, 3) for i in range(50))
TEXTS_ALIKE = 0.8


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def pairs(spark, sf_dir):
    return neighbours.knn_pairs(vectors(spark, sf_dir), "vec_id", "embedding", K)


def knn_pairs(spark, sf_dir):
    return rounded(pairs(spark, sf_dir))


def details(spark, sf_dir, table_of_pairs):
    columns = {"label": F.col("label"), "first": F.round(F.col("embedding")[0].cast("double"), 6)}
    return rounded(neighbours.pair_details(table_of_pairs, vectors(spark, sf_dir), "vec_id", columns))


def pair_details(spark, sf_dir):
    return details(spark, sf_dir, pairs(spark, sf_dir))


def top_pairs(spark, sf_dir):
    return details(spark, sf_dir, neighbours.top_pairs(pairs(spark, sf_dir), 100))


def review_pairs(spark, sf_dir):
    return details(spark, sf_dir, neighbours.review_pairs(pairs(spark, sf_dir), *BAND, 80))


def rows(spark, sf_dir):
    """Vectors as rows to cluster; label 0 is the positive class."""
    return vectors(spark, sf_dir).select("vec_id", (F.col("label") == 0).cast("int").alias("target"))


def clusters(spark, sf_dir):
    return components.clusters(rows(spark, sf_dir), "vec_id", pairs(spark, sf_dir), CLUSTER)


def parts(spark, sf_dir):
    return splits.stratified_split(rows(spark, sf_dir), "vec_id", "target", [SEED]).drop("seed")


def cluster_threshold_sweep(spark, sf_dir):
    return rounded(components.threshold_sweep(parts(spark, sf_dir), "vec_id", "target", pairs(spark, sf_dir), SWEEP))


def leakage_near(spark, sf_dir):
    clustered = components.clusters(parts(spark, sf_dir), "vec_id", pairs(spark, sf_dir), CLUSTER)
    return rounded(duplicates.leakage(clustered, "cluster"))


def embedding_rows(spark, sf_dir):
    """One row per text: the length of its embedding vector and its norm, which must be 1 or 0."""
    embedded = svd_embedding(postings(spark, sf_dir), "job_id", "combined_text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x))
    return embedded.select("job_id", F.size("embedding").alias("dimensions"), F.round(norm, 6).alias("norm"))


def near_duplicate_pairs(spark, sf_dir):
    return rounded(studies.near_duplicate_pairs(postings(spark, sf_dir)))


def similar_pairs(spark, sf_dir):
    """Every pair of texts at ``TEXTS_ALIKE`` or more in the space of their terms."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    model = TfIdf("text").fit(docs)
    return allpairs.pairs_above(model.transform(docs), "doc_id", allpairs.sparse_entries("text_vector"), TEXTS_ALIKE)


def pairs_above(spark, sf_dir):
    return rounded(similar_pairs(spark, sf_dir).pairs)


def pairs_above_links(spark, sf_dir):
    return similar_pairs(spark, sf_dir).links().withColumnRenamed("id", "doc_id")


def every_pair(spark, sf_dir):
    """The dense vectors' pairs at a threshold, without a number of neighbours, copies included."""
    return rounded(neighbours.every_pair_above(vectors(spark, sf_dir), "vec_id", "embedding", CLUSTER))


def forest_sweep(spark, sf_dir):
    return rounded(forest.forest_sweep(parts(spark, sf_dir), "vec_id", "target", pairs(spark, sf_dir), FOREST_SWEEP))


QUERIES = {
    "pairs_above": pairs_above, "pairs_above_links": pairs_above_links, "every_pair": every_pair, "forest_sweep": forest_sweep,
    "knn_pairs": knn_pairs, "pair_details": pair_details, "top_pairs": top_pairs, "review_pairs": review_pairs,
    "clusters": clusters, "cluster_threshold_sweep": cluster_threshold_sweep, "leakage_near": leakage_near,
    "svd_embedding": embedding_rows, "near_duplicate_pairs": near_duplicate_pairs,
}

PAIRS = """
vec AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings),
sims AS (
  SELECT a.vec_id AS id, b.vec_id AS other, array_cosine_similarity(a.e, b.e) AS s FROM vec a, vec b WHERE a.vec_id <> b.vec_id
),
near AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other) <= 7),
pairs AS (
  SELECT least(id, other) AS row_a, greatest(id, other) AS row_b, max(s) AS cosine_similarity FROM near GROUP BY ALL
)"""


def sql_details(source: str) -> str:
    return f"""SELECT row_a, row_b, round(cosine_similarity, 6) AS cosine_similarity, a.label AS label_a, b.label AS label_b,
      round(a.e[1], 6) AS first_a, round(b.e[1], 6) AS first_b
      FROM {source} p JOIN vec a ON a.vec_id = row_a JOIN vec b ON b.vec_id = row_b"""


def sql_reach(thresholds) -> str:
    """Every row and the smallest row it can reach, per threshold. RECURSIVE."""
    listed = ", ".join(f"{t}::DOUBLE" for t in thresholds)
    return f"""
links AS (
  SELECT t, row_a AS u, row_b AS v FROM pairs, (SELECT unnest([{listed}]) AS t) WHERE cosine_similarity >= t
  UNION ALL SELECT t, row_b, row_a FROM pairs, (SELECT unnest([{listed}]) AS t) WHERE cosine_similarity >= t
),
reach AS (
  SELECT t, vec_id AS u, vec_id AS v FROM vec, (SELECT unnest([{listed}]) AS t)
  UNION SELECT r.t, r.u, l.v FROM reach r JOIN links l ON l.t = r.t AND l.u = r.v
),
labelled AS (
  SELECT r.t, r.u AS vec_id, min(r.v) AS cluster, (any_value(label) = 0)::INT AS target
  FROM reach r JOIN vec ON vec.vec_id = r.u GROUP BY r.t, r.u
)"""


PARTS = f"""
base AS (SELECT vec_id, (label = 0)::INT AS target FROM embeddings),
qb AS (SELECT target, count(*) * ceil(0.25 * (SELECT count(*) FROM base)) / (SELECT count(*) FROM base)::DOUBLE AS fair FROM base GROUP BY 1),
qq AS (SELECT target, floor(fair) + (row_number() OVER (ORDER BY fair - floor(fair) DESC, target)
  <= ceil(0.25 * (SELECT count(*) FROM base)) - (SELECT sum(floor(fair)) FROM qb))::INT AS n_test FROM qb),
parts AS (SELECT vec_id, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY {sql_hash(SEED, 'vec_id')}) <= n_test
  THEN 'test' ELSE 'train' END AS part FROM base JOIN qq USING (target))"""
LEAKS = """
sides AS (SELECT t, cluster, count(*) FILTER (part = 'test') AS te, count(*) FILTER (part = 'train') AS tr
  FROM labelled JOIN parts USING (vec_id) GROUP BY t, cluster),
leaks AS (SELECT t, count(*) FILTER (te > 0 AND tr > 0) AS overlapping_clusters,
    coalesce(sum(te) FILTER (te > 0 AND tr > 0), 0)::BIGINT AS test_rows_with_train_cluster,
    round(coalesce(sum(te) FILTER (te > 0 AND tr > 0), 0) / sum(te)::DOUBLE, 6) AS share_test_rows_with_train_cluster
  FROM sides GROUP BY t)"""



def sql_sweep(thresholds) -> str:
    return f"""WITH RECURSIVE {PAIRS}, {sql_reach(thresholds)}, {PARTS}, {LEAKS},
        g AS (SELECT t, cluster, count(*) AS n, sum(target) AS f FROM labelled GROUP BY t, cluster)
        SELECT t AS similarity_threshold, count(*) FILTER (n > 1) AS cluster_count,
          coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_clusters, max(n) AS largest_cluster,
          count(*) FILTER (n > 1 AND f > 0 AND f < n) AS mixed_label_clusters,
          round(sum(f) FILTER (n > 1) / sum(n) FILTER (n > 1)::DOUBLE, 6) AS fake_rate_clustered_rows,
          any_value(overlapping_clusters) AS overlapping_clusters,
          any_value(test_rows_with_train_cluster) AS test_rows_with_train_cluster,
          any_value(share_test_rows_with_train_cluster) AS share_test_rows_with_train_cluster
        FROM g JOIN leaks USING (t) GROUP BY t"""


SIMILAR = f"""{VOCABULARY},
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n_docs) / (1 + df)::DOUBLE) + 1) AS w FROM counts JOIN vocab USING (term)),
unit AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
bags AS (SELECT doc_id, list([term, tf::VARCHAR] ORDER BY term) AS bag FROM counts JOIN vocab USING (term) GROUP BY doc_id),
members AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY bag) AS rep, count(*) OVER (PARTITION BY bag) AS copies FROM bags),
reps AS (SELECT unit.* FROM unit JOIN members USING (doc_id) WHERE doc_id = rep),
alike AS (
  SELECT a.doc_id AS row_a, b.doc_id AS row_b, sum(a.w * b.w) AS s FROM reps a JOIN reps b ON a.term = b.term AND a.doc_id < b.doc_id
  GROUP BY ALL HAVING sum(a.w * b.w) >= {TEXTS_ALIKE})"""

ORACLES = {
    "pairs_above": f"WITH {SIMILAR} SELECT row_a, row_b, round(least(s, 1), 6) AS cosine_similarity FROM alike",
    "pairs_above_links": f"""WITH {SIMILAR},
        sides AS (SELECT row_a AS rep, row_b AS other FROM alike UNION ALL SELECT row_b, row_a FROM alike),
        reached AS (SELECT sides.rep, sum(copies) AS n FROM sides JOIN members ON doc_id = other GROUP BY sides.rep)
        SELECT doc_id, rep, (coalesce(n, 0) + copies - 1)::BIGINT AS links FROM members LEFT JOIN reached USING (rep)""",
    "every_pair": f"""WITH {PAIRS} SELECT id AS row_a, other AS row_b, round(s, 6) AS cosine_similarity FROM sims
        WHERE id < other AND s >= {CLUSTER}""",
    "knn_pairs": f"WITH {PAIRS} SELECT row_a, row_b, round(cosine_similarity, 6) AS cosine_similarity FROM pairs",
    "pair_details": f"WITH {PAIRS} {sql_details('pairs')}",
    "top_pairs": f"WITH {PAIRS} {sql_details('(SELECT * FROM pairs ORDER BY cosine_similarity DESC, row_a, row_b LIMIT 100)')}",
    "review_pairs": f"""WITH {PAIRS} {sql_details(f'''(SELECT * FROM pairs WHERE cosine_similarity BETWEEN {BAND[0]} AND {BAND[1]}
        ORDER BY cosine_similarity DESC, row_a, row_b LIMIT 80)''')}""",
    "clusters": f"WITH RECURSIVE {PAIRS}, {sql_reach([CLUSTER])} SELECT vec_id, target, cluster FROM labelled",
    "cluster_threshold_sweep": sql_sweep(SWEEP),
    "forest_sweep": sql_sweep(FOREST_SWEEP),
    "leakage_near": f"""WITH RECURSIVE {PAIRS}, {sql_reach([CLUSTER])}, {PARTS}, {LEAKS}
        SELECT * EXCLUDE (t) FROM leaks""",
}
