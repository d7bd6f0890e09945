"""The driver's tables in the roles of the study, once for Spark and once as SQL text.

The SQL is written against the source tables and shares nothing with the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpaudit.operators.postings import prepared
from corpaudit.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating columns rounded, so that the order of summation does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``labels`` in the shape of the raw posting table."""
    docs = spread(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    lines = F.split("text", "\n")
    several = F.size(lines) > 1
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    return docs.select(
        F.col("doc_id").alias("job_id"),
        F.when(several, lines[0]).otherwise(F.substring("text", 1, 60)).alias("title"),
        F.get(lines, F.lit(1)).alias("company_profile"),
        F.when(several, F.substring("text", F.length(lines[0]) + 2, F.length("text")))
        .otherwise(F.substring("text", F.lit(61), F.length("text"))).alias("description"),
        F.get(lines, F.lit(2)).alias("requirements"),
        F.get(lines, F.lit(3)).alias("benefits"),
        F.get(lines, F.lit(4)).alias("salary_range"),
        F.col("source").alias("location"),
        F.when(F.col("quality").isNotNull(), F.col("source")).alias("department"),
        F.col("lang").alias("employment_type"),
        size.alias("required_experience"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("required_education"),
        F.col("source").alias("industry"),
        F.col("lang").alias("function"),
        (F.coalesce("quality", F.lit(1)) == 0).cast("int").alias("telecommuting"),
        F.get(lines, F.lit(2)).isNotNull().cast("int").alias("has_company_logo"),
        F.coalesce("quality", F.lit(0)).cast("int").alias("has_questions"),
        F.coalesce("toxic", F.lit(0)).cast("int").alias("fraudulent"),
        F.col("n_chars"),
    )


POSTINGS = """
lines AS (
  SELECT d.*, l.quality, l.toxic, str_split(d.text, chr(10)) AS ls
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
postings AS (
  SELECT doc_id AS job_id,
    CASE WHEN len(ls) > 1 THEN ls[1] ELSE substr(text, 1, 60) END AS title,
    ls[2] AS company_profile,
    CASE WHEN len(ls) > 1 THEN substr(text, length(ls[1]) + 2) ELSE substr(text, 61) END AS description,
    ls[3] AS requirements, ls[4] AS benefits, ls[5] AS salary_range,
    source AS location, CASE WHEN quality IS NOT NULL THEN source END AS department,
    lang AS employment_type,
    CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS required_experience,
    CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS required_education,
    source AS industry, lang AS "function",
    (coalesce(quality, 1) = 0)::INT AS telecommuting, (ls[3] IS NOT NULL)::INT AS has_company_logo,
    coalesce(quality, 0)::INT AS has_questions, coalesce(toxic, 0)::INT AS fraudulent, n_chars
  FROM lines
)"""

TEXTS = ("title", "company_profile", "description", "requirements", "benefits")
BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_combined(prefix: str = "") -> str:
    return " || ' ' || ".join(f"coalesce({prefix}{c}, '')" for c in TEXTS)


def sql_normalised(expr: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({expr}, '')), '{BLANK}', ' ', 'g'), ' ')"


def sql_words(expr: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({expr}, ''), '{BLANK}'), lambda w: w <> ''))"


PREPARED = POSTINGS + f""",
prepared AS (
  SELECT job_id, fraudulent, n_chars,
    {", ".join(f"coalesce({c}, '') AS {c}" for c in TEXTS)},
    {", ".join(f'coalesce("{c}", {chr(39)*2}) AS "{c}"' for c in ("location", "department", "employment_type", "required_experience", "required_education", "industry", "function"))},
    telecommuting, has_company_logo, has_questions,
    (salary_range IS NOT NULL)::INT AS has_salary_range, (benefits IS NOT NULL)::INT AS has_benefits,
    (company_profile IS NOT NULL)::INT AS has_company_profile, (department IS NOT NULL)::INT AS has_department,
    {", ".join(f"length(coalesce({c}, '')) AS {c}_length" for c in TEXTS)},
    {", ".join(f"{sql_words(c)} AS {c}_word_count" for c in TEXTS)},
    {sql_combined()} AS combined_text,
    sha1({" || ' ||| ' || ".join(sql_normalised(c) for c in TEXTS)}) AS content_signature,
    sha1({sql_normalised(sql_combined())}) AS exact_signature
  FROM postings
)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(raw_postings(spark, sf_dir))


def scored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with a score that depends on the text's size only: a stand-in for a fitted model."""
    score = ((F.col("n_chars") * 7919) % 1000) / 500.0 - 1.0
    return postings(spark, sf_dir).withColumns({"label": F.col("fraudulent"), "score": score})


SCORED = PREPARED + """,
scored AS (
  SELECT *, fraudulent AS label, ((n_chars * 7919) % 1000) / 5e2::DOUBLE - 1e0::DOUBLE AS score FROM prepared
),
grouped AS (
  SELECT *, (score >= 0)::INT AS predicted,
    CASE WHEN label = 1 AND score >= 0 THEN 'True positive' WHEN label = 1 THEN 'False negative'
         WHEN score >= 0 THEN 'False positive' ELSE 'True negative' END AS prediction_group
  FROM scored
)"""


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a score table with many equal scores."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        (F.col("value") - 100.0).alias("score"),
        "user_id",
    )


EVENTS = """
ev AS (
  SELECT event_id AS id, (event_type = 'error')::INT AS label, value - 100.0::DOUBLE AS score, user_id FROM events
)"""


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as scores of several models, seeds, protocols, datasets and folds."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    protocols = F.array(F.lit("random_stratified"), F.lit("exact_duplicate_group"), F.lit("near_template_group_098"))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.col("o_totalprice") / 100000.0 - 2.5).alias("score"),
        F.col("o_orderpriority").alias("model"),
        (customer % 5).cast("int").alias("seed"),
        F.get(protocols, (key % 3).cast("int")).alias("split_protocol"),
        F.when(key % 2 == 0, "cleaned").otherwise("original").alias("dataset"),
    )


ORDERS = """
oscores AS (
  SELECT o_orderkey AS id, (o_orderstatus = 'F')::INT AS label,
    o_totalprice / 1e5::DOUBLE - 2.5::DOUBLE AS score, o_orderpriority AS model, (o_custkey % 5)::INT AS seed,
    ['random_stratified', 'exact_duplicate_group', 'near_template_group_098'][(o_orderkey % 3)::INT + 1] AS split_protocol,
    CASE WHEN o_orderkey % 2 = 0 THEN 'cleaned' ELSE 'original' END AS dataset
  FROM orders
)"""


def sql_metrics(source: str, by: str, name: str, threshold: str = "0") -> str:
    """CTEs ending in ``name``: metrics per group, from row-level windows (peers share a frame)."""
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    grouping = f"GROUP BY {by}" if by else ""
    return f"""
{name}_rows AS (
  SELECT *, sum(label) OVER ({part}ORDER BY score DESC) / count(*) OVER ({part}ORDER BY score DESC)::DOUBLE AS prec,
    rank() OVER ({part}ORDER BY score) + (count(*) OVER (PARTITION BY {lead}score) - 1) / 2e0::DOUBLE AS mid_rank
  FROM {source}
),
{name}_counts AS (
  SELECT {lead}
    count(*) FILTER (label = 1 AND score >= {threshold}) AS tp, count(*) FILTER (label = 0 AND score >= {threshold}) AS fp,
    count(*) FILTER (label = 1 AND score < {threshold}) AS fn, count(*) FILTER (label = 0 AND score < {threshold}) AS tn,
    avg(prec) FILTER (label = 1) AS ap,
    CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN
      (sum(mid_rank) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2e0::DOUBLE)
        / (sum(label) * (count(*) - sum(label)))::DOUBLE END AS auc
  FROM {name}_rows {grouping}
),
{name} AS (
  SELECT {lead}
    (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy,
    (coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / 2 AS balanced_accuracy,
    auc AS roc_auc, coalesce(ap, 0) AS average_precision,
    coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS fake_precision,
    coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS fake_recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS fake_f1,
    (tp + fp) / (tp + fp + fn + tn)::DOUBLE AS predicted_fake_rate,
    tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives
  FROM {name}_counts
)"""


METRIC_COLUMNS = (
    "accuracy", "balanced_accuracy", "roc_auc", "average_precision",
    "fake_precision", "fake_recall", "fake_f1", "predicted_fake_rate",
)
COUNT_COLUMNS = ("true_positives", "false_positives", "false_negatives", "true_negatives")


def sql_round(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
