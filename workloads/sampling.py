"""Splits, leakage and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpaudit.operators import duplicates, sampling, splits
from corpaudit.operators.models import union_all
from corpaudit.plans.studies import LEAKAGE_SEEDS, leakage_by_seed
from workloads.views import EVENTS, PREPARED, event_scores, order_scores, ORDERS, postings, rounded

KEY, TARGET, SEED = "job_id", "fraudulent", 42
PREVALENCE_REPEATS = 200


def slim(spark, sf_dir):
    return postings(spark, sf_dir).select(KEY, TARGET, "exact_signature", "content_signature")


def stratified_split(spark, sf_dir):
    return splits.stratified_split(slim(spark, sf_dir), KEY, TARGET, [SEED]).select(KEY, TARGET, "part")


def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(slim(spark, sf_dir), KEY, TARGET, 5, SEED).select(KEY, TARGET, "fold")


def group_split(spark, sf_dir):
    return splits.group_split(slim(spark, sf_dir), "content_signature", TARGET, SEED).select(KEY, "content_signature", "part")


def best_group_split(spark, sf_dir):
    groups = splits.group_table(slim(spark, sf_dir), "content_signature", TARGET).persist()
    best = splits.best_candidate(groups, "content_signature", SEED, 100)
    return rounded(best.select("candidate", "cutoff", "test_rows", "test_positives", "gap"))


def order_split(spark, sf_dir):
    return splits.order_split(slim(spark, sf_dir), KEY).select(KEY, "part")


def protocol_parts(spark, sf_dir):
    """The three protocols; near groups are here the field-wise signatures."""
    df = slim(spark, sf_dir)
    return union_all([
        splits.split_by_protocol(df, protocol, SEED, KEY, TARGET, near_group="content_signature")
        .select(KEY, TARGET, "part", F.lit(protocol).alias("split_protocol"))
        for protocol in splits.PROTOCOLS
    ])


def split_protocols(spark, sf_dir):
    return protocol_parts(spark, sf_dir).select(KEY, "split_protocol", "part")


def split_stats(spark, sf_dir):
    return rounded(splits.split_stats(protocol_parts(spark, sf_dir), TARGET, ["split_protocol"]))


def leakage_exact(spark, sf_dir):
    parts = splits.stratified_split(slim(spark, sf_dir), KEY, TARGET, [SEED])
    return rounded(duplicates.leakage(parts, "exact_signature"))


def leakage_summary(spark, sf_dir):
    by_seed = leakage_by_seed(slim(spark, sf_dir), ["exact_signature", "content_signature"], LEAKAGE_SEEDS)
    return rounded(duplicates.leakage_summary(by_seed))


def undersample(spark, sf_dir):
    return sampling.undersample(slim(spark, sf_dir), KEY, TARGET, SEED).select(KEY, TARGET)


def oversample_equal(spark, sf_dir):
    return sampling.oversample(slim(spark, sf_dir), KEY, TARGET, None, SEED).select(KEY, TARGET, "draw")


def oversample_20(spark, sf_dir):
    return sampling.oversample(slim(spark, sf_dir), KEY, TARGET, 0.20, SEED).select(KEY, TARGET, "draw")


def label_scarcity_samples(spark, sf_dir):
    samples = sampling.label_scarcity_samples(
        slim(spark, sf_dir).select(KEY, TARGET), KEY, TARGET, sampling.SCARCITY_COUNTS, 3, SEED
    )
    return samples.select(KEY, TARGET, "fake_labels_available", "repeat")


def samples(spark, sf_dir):
    return sampling.prevalence_samples(event_scores(spark, sf_dir), repeats=PREVALENCE_REPEATS, seed=SEED)


def prevalence_samples(spark, sf_dir):
    """Drawn rows per sample with an order-free check of which rows they are."""
    runs = ["target_fake_prevalence", "repeat", "label"]
    return samples(spark, sf_dir).groupBy(*runs).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("distinct_rows"), F.sum("id").alias("id_sum")
    )


def prevalence_summary(spark, sf_dir):
    return rounded(sampling.prevalence_summary(samples(spark, sf_dir)))


QUERIES = {
    "leakage_exact": leakage_exact, "leakage_summary": leakage_summary, "stratified_split": stratified_split,
    "stratified_folds": stratified_folds, "group_split": group_split, "best_group_split": best_group_split,
    "order_split": order_split, "split_protocols": split_protocols, "split_stats": split_stats,
    "undersample": undersample, "oversample_equal": oversample_equal, "oversample_20": oversample_20,
    "label_scarcity_samples": label_scarcity_samples, "prevalence_samples": prevalence_samples,
    "prevalence_summary": prevalence_summary,
}


def sql_hash(*parts) -> str:
    return "md5(concat_ws(':', " + ", ".join(str(p) for p in parts) + "))"


def sql_stratified(seeds) -> str:
    """CTE ``strat``: every row once per seed with its part; class quotas by largest remainder."""
    listed = ", ".join(map(str, seeds))
    return f"""
quota_base AS (
  SELECT fraudulent AS label, count(*) AS n, ceil(0.25 * (SELECT count(*) FROM prepared)) AS want,
    count(*) * ceil(0.25 * (SELECT count(*) FROM prepared)) / (SELECT count(*) FROM prepared)::DOUBLE AS fair
  FROM prepared GROUP BY 1
),
quota AS (
  SELECT label, floor(fair) + (row_number() OVER (ORDER BY fair - floor(fair) DESC, label)
    <= want - (SELECT sum(floor(fair)) FROM quota_base))::INT AS n_test FROM quota_base
),
strat AS (
  SELECT p.*, seed, CASE WHEN row_number() OVER (PARTITION BY seed, fraudulent ORDER BY {sql_hash('seed', 'job_id')}) <= n_test
    THEN 'test' ELSE 'train' END AS part
  FROM prepared p JOIN quota ON label = fraudulent, (SELECT unnest([{listed}]) AS seed)
)"""


def sql_candidates(group: str, seed, candidates: int, name: str) -> str:
    """CTE ``name``: the best candidate's groups with their part."""
    return f"""
{name}_g AS (SELECT {group} AS g, count(*) AS n, sum(fraudulent) AS f FROM prepared GROUP BY 1),
{name}_r AS (
  SELECT c, g, n, f, h, row_number() OVER (PARTITION BY c ORDER BY h) <= ceil(0.25 * (SELECT count(*) FROM {name}_g)) AS in_test
  FROM (SELECT *, {sql_hash(seed, 'c', 'g')} AS h FROM {name}_g, range({candidates}) t(c))
),
{name}_s AS (
  SELECT c, max(h) FILTER (in_test) AS cutoff, (sum(n) FILTER (in_test))::BIGINT AS test_rows,
    (sum(f) FILTER (in_test))::BIGINT AS test_positives, sum(n) AS rows, sum(f) AS pos FROM {name}_r GROUP BY c
),
{name}_best AS (
  SELECT *, abs(test_positives / test_rows::DOUBLE - pos / rows::DOUBLE) + abs(test_rows / rows::DOUBLE - 0.25) AS gap
  FROM {name}_s WHERE test_positives > 0 AND test_positives < pos ORDER BY gap, c LIMIT 1
),
{name} AS (
  SELECT job_id, fraudulent, CASE WHEN in_test THEN 'test' ELSE 'train' END AS part
  FROM prepared JOIN {name}_r ON g = {group} JOIN {name}_best USING (c)
)"""


PROTOCOLS = f"""{PREPARED}, {sql_stratified([SEED])},
  {sql_candidates('exact_signature', SEED, 30, 'ex')}, {sql_candidates('content_signature', SEED, 30, 'nr')},
  parts AS (
    SELECT job_id, fraudulent, part, 'random_stratified' AS split_protocol FROM strat
    UNION ALL SELECT *, 'exact_duplicate_group' FROM ex UNION ALL SELECT *, 'near_template_group_098' FROM nr
  )"""


def sql_position(h: str, n: str) -> str:
    return f"(('0x' || substr({h}, 1, 15))::BIGINT % {n})"


def sql_oversample(wanted: str, without_when_short: bool) -> str:
    draws = f"SELECT i AS draw, {sql_position(sql_hash(SEED, chr(39) + 'draw' + chr(39), 'i'), '(SELECT count(*) FROM pos)')} AS k FROM range({wanted}) t(i)"
    if without_when_short:
        draws = f"SELECT i AS draw, CASE WHEN {wanted} <= (SELECT count(*) FROM pos) THEN i ELSE k END AS k FROM (SELECT draw AS i, k FROM ({draws}))"
    return f"""WITH {PREPARED},
      pos AS (SELECT job_id, fraudulent, row_number() OVER (ORDER BY {sql_hash(SEED, 'job_id')}) - 1 AS k
        FROM prepared WHERE fraudulent = 1),
      neg AS (SELECT count(*) AS n FROM prepared WHERE fraudulent = 0)
      SELECT job_id, fraudulent, -1::BIGINT AS draw FROM prepared WHERE fraudulent = 0
      UNION ALL SELECT job_id, fraudulent, draw FROM ({draws}) JOIN pos USING (k)"""


SCARCITY = f"""WITH {PREPARED},
  pos AS (SELECT job_id, row_number() OVER (ORDER BY {sql_hash(SEED, 'job_id')}) - 1 AS k FROM prepared WHERE fraudulent = 1),
  np AS (SELECT count(*) AS n FROM pos),
  runs AS (
    SELECT c, r FROM (SELECT unnest([50, 100, 200, 400]) AS c), (SELECT unnest([0, 1, 2]) AS r)
    UNION SELECT n, 0 FROM np WHERE n NOT IN (50, 100, 200, 400)
  )
  SELECT job_id, fraudulent, c AS fake_labels_available, r AS repeat FROM prepared, runs WHERE fraudulent = 0
  UNION ALL
  SELECT job_id, 1, c, r FROM (
    SELECT job_id, c, r, row_number() OVER (PARTITION BY c, r ORDER BY {sql_hash(SEED, 'c', 'r', 'job_id')}) AS place
    FROM pos, runs WHERE c <= (SELECT n FROM np)) WHERE place <= c
  UNION ALL
  SELECT job_id, 1, c, r FROM (
    SELECT c, r, {sql_position(sql_hash(SEED, 'c', 'r', "'draw'", 'i'), '(SELECT n FROM np)')} AS k
    FROM runs, range(400) t(i) WHERE c > (SELECT n FROM np) AND i < c) JOIN pos USING (k)"""

# Spark and DuckDB write these rates the same way: 0.01, 0.025, 0.05, 0.1, 0.2.
PREVALENCE = f"""{EVENTS},
  pool AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash(SEED, 'id')}) - 1 AS k FROM ev),
  sizes AS (SELECT label, count(*) AS size FROM ev GROUP BY label),
  rates AS (SELECT unnest([0.01, 0.025, 0.05, 0.1, 0.2])::DOUBLE AS rate),
  plan AS (
    SELECT *, CASE WHEN n > size THEN 'repeat' WHEN 2 * n > size THEN 'drop' ELSE 'take' END AS mode,
      CASE WHEN 2 * n > size THEN size - n ELSE n END AS distinct_n
    FROM (SELECT rate, label, size, CASE label WHEN 1 THEN greatest(1, round_even(3000 * rate, 0))
      ELSE 3000 - greatest(1, round_even(3000 * rate, 0)) END::BIGINT AS n FROM rates, sizes)
  ),
  slots AS (
    SELECT *, {sql_position(sql_hash(SEED, 'rate', 'repeat', 'label', 'i'), 'size')} AS k FROM (
      SELECT plan.*, repeat, unnest(range(CASE mode WHEN 'repeat' THEN n ELSE 4 * distinct_n + 64 END)) AS i
      FROM plan, range({PREVALENCE_REPEATS}) t(repeat))
  ),
  firsts AS (
    SELECT rate, repeat, label, mode, k FROM (
      SELECT rate, repeat, label, mode, distinct_n, k, min(i) AS i FROM slots WHERE mode <> 'repeat' GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY rate, repeat, label ORDER BY i) <= distinct_n
  ),
  places AS (
    SELECT rate, repeat, label, k FROM slots WHERE mode = 'repeat'
    UNION ALL SELECT rate, repeat, label, k FROM firsts WHERE mode = 'take'
    UNION ALL (SELECT rate, repeat, label, k FROM (
        SELECT rate, repeat, label, unnest(range(size)) AS k FROM plan, range({PREVALENCE_REPEATS}) t(repeat) WHERE mode = 'drop')
      EXCEPT SELECT rate, repeat, label, k FROM firsts WHERE mode = 'drop')
  ),
  sampled AS (SELECT rate, repeat, label, id, score FROM places JOIN pool USING (label, k))"""

ORACLES = {
    "leakage_exact": f"""WITH {PREPARED}, {sql_stratified([SEED])},
        leaked AS (SELECT * FROM strat WHERE part = 'test' AND exact_signature IN (SELECT exact_signature FROM strat WHERE part = 'train'))
        SELECT count(DISTINCT exact_signature) AS overlapping_clusters, count(*) AS test_rows_with_train_cluster,
          round(count(*) / (SELECT count(*) FROM strat WHERE part = 'test')::DOUBLE, 6) AS share_test_rows_with_train_cluster FROM leaked""",
    "leakage_summary": f"""WITH {PREPARED}, {sql_stratified(LEAKAGE_SEEDS)},
        long AS (SELECT seed, part, 'exact_signature' AS cluster_type, exact_signature AS g FROM strat
          UNION ALL SELECT seed, part, 'content_signature', content_signature FROM strat),
        one AS (SELECT t.cluster_type, t.seed, count(DISTINCT t.g) FILTER (hit) AS groups, count(*) FILTER (hit) AS rows,
            avg(hit::INT) AS share
          FROM (SELECT *, EXISTS (SELECT 1 FROM long b WHERE b.part = 'train' AND b.seed = a.seed AND b.cluster_type = a.cluster_type AND b.g = a.g) AS hit
            FROM long a WHERE part = 'test') t GROUP BY 1, 2)
        SELECT cluster_type, round(avg(groups), 6) AS overlapping_clusters_mean,
          round(avg(rows), 6) AS test_rows_with_train_cluster_mean, round(avg(share), 6) AS share_test_rows_with_train_cluster_mean,
          round(stddev_samp(share), 6) AS share_test_rows_with_train_cluster_std FROM one GROUP BY cluster_type""",
    "stratified_split": f"WITH {PREPARED}, {sql_stratified([SEED])} SELECT job_id, fraudulent, part FROM strat",
    "stratified_folds": f"""WITH {PREPARED} SELECT job_id, fraudulent,
        ntile(5) OVER (PARTITION BY fraudulent ORDER BY {sql_hash(SEED, 'job_id')}) - 1 AS fold FROM prepared""",
    "group_split": f"""WITH {PREPARED}, g AS (SELECT content_signature AS s,
          row_number() OVER (ORDER BY {sql_hash(SEED, 0, 'content_signature')}) AS k FROM (SELECT DISTINCT content_signature FROM prepared))
        SELECT job_id, content_signature,
          CASE WHEN k <= ceil(0.25 * (SELECT count(*) FROM g)) THEN 'test' ELSE 'train' END AS part
        FROM prepared JOIN g ON s = content_signature""",
    "best_group_split": f"""WITH {PREPARED}, {sql_candidates('content_signature', SEED, 100, 'b')}
        SELECT c AS candidate, cutoff, test_rows, test_positives, round(gap, 6) AS gap FROM b_best""",
    "order_split": f"""WITH {PREPARED} SELECT job_id, CASE WHEN row_number() OVER (ORDER BY job_id)
        <= round_even(0.75 * (SELECT count(*) FROM prepared), 0) THEN 'train' ELSE 'test' END AS part FROM prepared""",
    "split_protocols": f"WITH {PROTOCOLS} SELECT job_id, split_protocol, part FROM parts",
    "split_stats": f"""WITH {PROTOCOLS} SELECT split_protocol, count(*) FILTER (part = 'train') AS train_rows,
        count(*) FILTER (part = 'test') AS test_rows, round(avg(fraudulent) FILTER (part = 'train'), 6) AS train_fake_rate,
        round(avg(fraudulent) FILTER (part = 'test'), 6) AS test_fake_rate,
        (sum(fraudulent) FILTER (part = 'test'))::BIGINT AS test_fake_count FROM parts GROUP BY split_protocol""",
    "undersample": f"""WITH {PREPARED} SELECT job_id, fraudulent FROM prepared
        QUALIFY fraudulent = 1 OR row_number() OVER (PARTITION BY fraudulent ORDER BY {sql_hash(SEED, 'job_id')})
          <= (SELECT count(*) FROM prepared WHERE fraudulent = 1)""",
    "oversample_equal": sql_oversample("(SELECT n FROM neg)", False),
    "oversample_20": sql_oversample("(SELECT round_even(0.2 / 0.8 * n, 0)::BIGINT FROM neg)", True),
    "label_scarcity_samples": SCARCITY,
    "prevalence_samples": f"""WITH {PREVALENCE} SELECT rate AS target_fake_prevalence, repeat, label, count(*) AS rows,
        count(DISTINCT id) AS distinct_rows, sum(id)::BIGINT AS id_sum FROM sampled GROUP BY ALL""",
    "prevalence_summary": f"""WITH {PREVALENCE}, c AS (SELECT rate, repeat,
          count(*) FILTER (label = 1 AND score >= 0) AS tp, count(*) FILTER (label = 0 AND score >= 0) AS fp,
          count(*) FILTER (label = 1 AND score < 0) AS fn, count(*) AS n FROM sampled GROUP BY rate, repeat),
        m AS (SELECT rate, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r,
          coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f, (tp + fp) / n::DOUBLE AS flagged, fp, fn FROM c)
        SELECT rate AS target_fake_prevalence, round(avg(p), 6) AS fake_precision_mean, round(stddev_samp(p), 6) AS fake_precision_std,
          round(avg(r), 6) AS fake_recall_mean, round(stddev_samp(r), 6) AS fake_recall_std, round(avg(f), 6) AS fake_f1_mean,
          round(stddev_samp(f), 6) AS fake_f1_std, round(avg(flagged), 6) AS predicted_fake_rate_mean,
          round(avg(fp), 6) AS false_positives_mean, round(avg(fn), 6) AS false_negatives_mean FROM m GROUP BY rate""",
}
