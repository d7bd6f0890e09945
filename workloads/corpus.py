"""Cleaning, profiling and duplicate queries over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpaudit.functions import text as tx
from corpaudit.operators import duplicates, errors, features, postings as po, profile
from corpaudit.operators.textfeatures import tfidf, vocabulary, with_tokens
from corpaudit.roles import POSTING_ROLES
from corpaudit.sources.corpus import read_corpus, side_by_side
from corpaudit.roles import Roles
from corpaudit.session import spread
from workloads.views import (
    BLANK, POSTINGS, PREPARED, TEXTS, postings, raw_postings, rounded, scored_postings, sql_combined, sql_normalised,
    sql_words, table,
)

TARGET = "fraudulent"
STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.ENGLISH_STOP_WORDS)
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}')"
TOKEN_TABLES = f"""
toks AS (SELECT doc_id, {TOKENS} AS t FROM documents),
kept AS (SELECT doc_id, list_filter(t, lambda w: NOT list_contains([{STOPS}], w)) AS t FROM toks),
grams AS (
  SELECT doc_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS t FROM kept
)"""
VOCABULARY = TOKEN_TABLES + """,
counts AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM grams) GROUP BY ALL
),
vocab AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, (SELECT count(*) FROM documents) AS n_docs
  FROM counts GROUP BY term HAVING count(*) >= 2
  ORDER BY cf DESC, term LIMIT 8000
)"""
DOCUMENT_ROLES = Roles(key="doc_id", target="lang", text=("text",), categorical=("source",))
FLAGS = ("has_salary_range", "has_benefits", "has_company_profile", "has_department")
TWO_DATASETS = """
both_sets AS (
  SELECT 'documents' AS dataset, doc_id AS id, text, coalesce(toxic, 0) AS target
  FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL
  SELECT 'conversations', conv_id, text, (role = 'assistant')::INT FROM conversations
),
summary AS (
  SELECT dataset, count(*) AS rows, 3 AS columns, count(*) FILTER (target = 0) AS real_count,
    count(*) FILTER (target = 1) AS fake_count, avg(target) AS fake_rate
  FROM both_sets GROUP BY dataset
)"""


def scan_corpus(spark, sf_dir):
    docs = read_corpus(spark, f"{sf_dir}/documents.parquet", DOCUMENT_ROLES)
    return docs.select("doc_id", "lang", "source", F.length("text").alias("characters"))


def two_datasets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    talks = table(spark, sf_dir, "conversations")
    return side_by_side({
        "documents": docs.select(F.col("doc_id").alias("id"), "text", F.coalesce("toxic", F.lit(0)).alias("target")),
        "conversations": talks.select(
            F.col("conv_id").alias("id"), "text", (F.col("role") == "assistant").cast("int").alias("target")
        ),
    })


def dataset_summary(spark, sf_dir):
    return rounded(profile.dataset_summary(two_datasets(spark, sf_dir), "target"))


def majority_baseline(spark, sf_dir):
    return profile.majority_baseline(profile.dataset_summary(two_datasets(spark, sf_dir), "target"))


def clean_fields(spark, sf_dir):
    filled = po.with_filled(raw_postings(spark, sf_dir), default="missing")
    return filled.select("job_id", "benefits", "requirements", "department", "required_education")


def combined_text(spark, sf_dir):
    return raw_postings(spark, sf_dir).select("job_id", tx.combine([F.col(c) for c in TEXTS]).alias("combined_text"))


def normalized_text(spark, sf_dir):
    """Over page source, which has the noisiest blanks."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", tx.normalise(F.col("html")).alias("normalized_text"))


def content_signature(spark, sf_dir):
    return raw_postings(spark, sf_dir).select(
        "job_id", tx.field_signature([F.col(c) for c in TEXTS]).alias("content_signature")
    )


def exact_signature(spark, sf_dir):
    return raw_postings(spark, sf_dir).select(
        "job_id", tx.text_signature([F.col(c) for c in TEXTS]).alias("exact_signature")
    )


def text_lengths(spark, sf_dir):
    df = postings(spark, sf_dir)
    return df.select("job_id", *[c for c in POSTING_ROLES.lengths if c.endswith("_length")])


def word_counts(spark, sf_dir):
    df = postings(spark, sf_dir)
    return df.select("job_id", *[c for c in POSTING_ROLES.lengths if c.endswith("_word_count")])


def presence_flags(spark, sf_dir):
    return po.with_presence(raw_postings(spark, sf_dir)).select("job_id", *FLAGS)


def class_balance(spark, sf_dir):
    return rounded(profile.class_balance(postings(spark, sf_dir), TARGET))


def snippets(spark, sf_dir):
    return raw_postings(spark, sf_dir).select(
        "job_id",
        tx.snippet(F.col("description"), 240).alias("description_snippet"),
        tx.snippet(F.col("description"), 260, False).alias("raw_snippet"),
    )


def slugify(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("text__"), F.col("url"))
    return pages.select(
        "page_id",
        tx.slugify(F.col("url")).alias("slug"),
        tx.readable_feature(name).alias("feature"),
        tx.short_label(F.lit("url"), F.col("url")).alias("label"),
    )


def missing_rates(spark, sf_dir):
    return rounded(profile.missing_rates(raw_postings(spark, sf_dir)))


def length_summary(spark, sf_dir):
    return rounded(profile.length_summary(raw_postings(spark, sf_dir), TARGET, TEXTS), 4)


def category_rates(spark, sf_dir):
    return rounded(profile.category_rates(raw_postings(spark, sf_dir), TARGET, POSTING_ROLES.categorical))


def duplicate_groups(spark, sf_dir):
    return duplicates.duplicate_groups(postings(spark, sf_dir), "content_signature", TARGET)


def duplicate_summary(spark, sf_dir):
    return rounded(duplicates.duplicate_summary(duplicate_groups(spark, sf_dir)))


def cluster_summary(spark, sf_dir):
    return rounded(duplicates.cluster_summary(postings(spark, sf_dir), "exact_signature", TARGET))


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def joined_tokens(spark, sf_dir, stop_words, ngrams):
    tokens = with_tokens(documents(spark, sf_dir), "text", "tokens", stop_words, ngrams)
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


def tokens(spark, sf_dir):
    return joined_tokens(spark, sf_dir, None, 1)


def tokens_no_stop(spark, sf_dir):
    return joined_tokens(spark, sf_dir, tx.ENGLISH_STOP_WORDS, 1)


def ngrams(spark, sf_dir):
    return joined_tokens(spark, sf_dir, tx.ENGLISH_STOP_WORDS, 2)


def vocabulary_terms(spark, sf_dir):
    return vocabulary(with_tokens(documents(spark, sf_dir), "text"))


def tfidf_weights(spark, sf_dir):
    return rounded(tfidf(documents(spark, sf_dir), "doc_id", "text"))


def onehot(spark, sf_dir):
    return features.one_hot(raw_postings(spark, sf_dir), "job_id", POSTING_ROLES.categorical)


def measured(spark, sf_dir):
    """Numeric columns with gaps: lengths of the fields that are present."""
    raw = raw_postings(spark, sf_dir)
    return raw.select(
        "job_id", F.length("company_profile").alias("profile_length"), F.length("benefits").alias("benefits_length"),
        F.length("title").alias("title_length"), F.lit(7).alias("constant"),
    )


MEASURES = ("profile_length", "benefits_length", "title_length", "constant")
MEASURED = POSTINGS + """,
measured AS (
  SELECT job_id, length(company_profile) AS profile_length, length(benefits) AS benefits_length,
    length(title) AS title_length, 7 AS "constant" FROM postings
)"""


def median_impute(spark, sf_dir):
    return rounded(features.median_impute(measured(spark, sf_dir), MEASURES))


def maxabs_scale(spark, sf_dir):
    return rounded(features.scaled(measured(spark, sf_dir), MEASURES, "maxabs"))


def std_scale(spark, sf_dir):
    return rounded(features.scaled(measured(spark, sf_dir), MEASURES, "std"))


def normalized_vectors(spark, sf_dir):
    vectors = features.l2_normalised(table(spark, sf_dir, "embeddings"), "embedding")
    return rounded(vectors.select("vec_id", F.posexplode("embedding").alias("place", "x")))


def feature_columns(spark, sf_dir):
    return features.feature_columns(postings(spark, sf_dir))


def error_reasons(spark, sf_dir):
    return scored_postings(spark, sf_dir).select("job_id", errors.error_reasons().alias("reasons"))


QUERIES = {
    "scan_corpus": scan_corpus, "dataset_summary": dataset_summary, "majority_baseline": majority_baseline,
    "clean_fields": clean_fields, "combined_text": combined_text, "normalized_text": normalized_text,
    "content_signature": content_signature, "exact_signature": exact_signature, "text_lengths": text_lengths,
    "word_counts": word_counts, "presence_flags": presence_flags, "class_balance": class_balance,
    "snippets": snippets, "slugify": slugify, "missing_rates": missing_rates, "length_summary": length_summary,
    "category_rates": category_rates, "duplicate_groups": duplicate_groups, "duplicate_summary": duplicate_summary,
    "cluster_summary": cluster_summary, "tokens": tokens, "tokens_no_stop": tokens_no_stop, "ngrams": ngrams,
    "vocabulary": vocabulary_terms, "tfidf": tfidf_weights, "onehot": onehot, "median_impute": median_impute,
    "maxabs_scale": maxabs_scale, "std_scale": std_scale, "normalized_vectors": normalized_vectors,
    "feature_columns": feature_columns, "error_reasons": error_reasons,
}

RAW_COLUMNS = (
    "job_id", "title", "company_profile", "description", "requirements", "benefits", "salary_range", "location",
    "department", "employment_type", "required_experience", "required_education", "industry", "function",
    "telecommuting", "has_company_logo", "has_questions", "fraudulent", "n_chars",
)
CATEGORIES = POSTING_ROLES.categorical


def union_columns(columns, select):
    return " UNION ALL ".join(select(c) for c in columns)


ORACLES = {
    "scan_corpus": "SELECT doc_id, lang, source, length(text) AS characters FROM documents",
    "dataset_summary": f"WITH {TWO_DATASETS} SELECT * REPLACE (round(fake_rate, 6) AS fake_rate) FROM summary",
    "majority_baseline": f"""WITH {TWO_DATASETS} SELECT dataset, rows, real_count, fake_count,
        printf('%.2f%%', fake_rate * 100) AS fake_rate, printf('%.2f%%', (1 - fake_rate) * 100) AS majority_class_accuracy
        FROM summary""",
    "clean_fields": f"""WITH {POSTINGS} SELECT job_id, coalesce(benefits, 'missing') AS benefits,
        coalesce(requirements, 'missing') AS requirements, coalesce(department, 'missing') AS department,
        coalesce(required_education, 'missing') AS required_education FROM postings""",
    "combined_text": f"WITH {POSTINGS} SELECT job_id, {sql_combined()} AS combined_text FROM postings",
    "normalized_text": f"SELECT page_id, {sql_normalised('html')} AS normalized_text FROM pages",
    "content_signature": f"WITH {PREPARED} SELECT job_id, content_signature FROM prepared",
    "exact_signature": f"WITH {PREPARED} SELECT job_id, exact_signature FROM prepared",
    "text_lengths": f"WITH {POSTINGS} SELECT job_id, "
    + ", ".join(f"length(coalesce({c}, '')) AS {c}_length" for c in TEXTS) + " FROM postings",
    "word_counts": f"WITH {POSTINGS} SELECT job_id, "
    + ", ".join(f"{sql_words(c)} AS {c}_word_count" for c in TEXTS) + " FROM postings",
    "presence_flags": f"WITH {PREPARED} SELECT job_id, {', '.join(FLAGS)} FROM prepared",
    "class_balance": f"""WITH {POSTINGS} SELECT CASE fraudulent WHEN 1 THEN 'Fake' ELSE 'Real' END AS label,
        count(*) AS count, round(count(*) / (SELECT count(*) FROM postings)::DOUBLE, 6) AS rate
        FROM postings GROUP BY fraudulent""",
    "snippets": f"""WITH {POSTINGS} SELECT job_id,
        substr(regexp_replace(description, '{BLANK}', ' ', 'g'), 1, 240) AS description_snippet,
        substr(description, 1, 260) AS raw_snippet FROM postings""",
    "slugify": """SELECT page_id,
        lower(trim(regexp_replace(url, '[^a-zA-Z0-9_]+', '_', 'g'), '_')) AS slug,
        'text: ' || url AS feature, 'url: ' || substr(url, 1, 35) AS label FROM pages""",
    "missing_rates": f"WITH {POSTINGS} SELECT \"column\", round(missing_rate, 6) AS missing_rate FROM ("
    + union_columns(RAW_COLUMNS, lambda c: f"SELECT '{c}' AS \"column\", avg((\"{c}\" IS NULL)::INT) AS missing_rate FROM postings")
    + ") ORDER BY missing_rate DESC, \"column\" LIMIT 15",
    "length_summary": f"""WITH {POSTINGS}, long AS ("""
    + union_columns(TEXTS, lambda c: f"SELECT CASE fraudulent WHEN 1 THEN 'Fake' ELSE 'Real' END AS label, '{c}' AS field, length(coalesce({c}, '')) AS characters FROM postings")
    + """) SELECT label, field, round(avg(characters), 4) AS mean, round(median(characters), 4) AS median,
        max(characters) AS max FROM long GROUP BY ALL""",
    "category_rates": f"WITH {POSTINGS}, long AS ("
    + union_columns(CATEGORIES, lambda c: f"SELECT '{c}' AS \"column\", coalesce(\"{c}\", 'missing') AS value, fraudulent FROM postings")
    + """) SELECT "column", value, count(*) AS count, round(avg(fraudulent), 6) AS fake_rate FROM long GROUP BY "column", value
        HAVING count(*) >= 30
        QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY avg(fraudulent) DESC, value) <= 8""",
    "duplicate_groups": f"""WITH {PREPARED} SELECT content_signature, count(*) AS group_size,
        sum(fraudulent)::BIGINT AS fake_count, count(*) FILTER (fraudulent = 0) AS real_count
        FROM prepared GROUP BY content_signature""",
    "duplicate_summary": f"""WITH {PREPARED},
        g AS (SELECT content_signature AS s, count(*) AS n, sum(fraudulent) AS f FROM prepared GROUP BY 1)
        SELECT (SELECT count(*) FROM prepared) AS rows, count(*) AS unique_content_signatures,
          count(*) FILTER (n > 1) AS duplicate_signature_groups,
          (sum(n) FILTER (n > 1))::BIGINT AS rows_in_duplicate_groups, max(n) AS largest_duplicate_group,
          count(*) FILTER (n > 1 AND f > 0 AND f < n) AS mixed_label_duplicate_groups,
          (SELECT round(avg(fraudulent), 6) FROM prepared WHERE content_signature IN (SELECT s FROM g WHERE n > 1))
            AS fake_rate_duplicate_rows FROM g""",
    "cluster_summary": f"""WITH {PREPARED},
        g AS (SELECT exact_signature AS s, count(*) AS n, sum(fraudulent) AS f FROM prepared GROUP BY 1)
        SELECT count(*) FILTER (n > 1) AS cluster_count, (sum(n) FILTER (n > 1))::BIGINT AS rows_in_clusters,
          max(n) AS largest_cluster, count(*) FILTER (n > 1 AND f > 0 AND f < n) AS mixed_label_clusters,
          (SELECT round(avg(fraudulent), 6) FROM prepared WHERE exact_signature IN (SELECT s FROM g WHERE n > 1))
            AS fake_rate_clustered_rows FROM g""",
    "tokens": f"WITH {TOKEN_TABLES} SELECT doc_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens FROM toks",
    "tokens_no_stop": f"WITH {TOKEN_TABLES} SELECT doc_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens FROM kept",
    "ngrams": f"WITH {TOKEN_TABLES} SELECT doc_id, len(t) AS n_tokens, array_to_string(t, '|') AS tokens FROM grams",
    "vocabulary": f"WITH {VOCABULARY} SELECT * FROM vocab",
    "tfidf": f"""WITH {VOCABULARY},
        w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n_docs) / (1 + df)::DOUBLE) + 1) AS w FROM counts JOIN vocab USING (term))
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
    "onehot": f"WITH {POSTINGS} "
    + union_columns(CATEGORIES, lambda c: f"SELECT job_id, '{c}_' || coalesce(\"{c}\", 'missing') AS feature, 1.0::DOUBLE AS value FROM postings"),
    "median_impute": f"WITH {MEASURED} SELECT job_id, "
    + ", ".join(f"coalesce(\"{c}\"::DOUBLE, (SELECT median(\"{c}\") FROM measured)) AS \"{c}\"" for c in MEASURES)
    + " FROM measured",
    "maxabs_scale": f"WITH {MEASURED} SELECT job_id, "
    + ", ".join(f"round(\"{c}\" / (SELECT max(abs(\"{c}\")) FROM measured)::DOUBLE, 6) AS \"{c}\"" for c in MEASURES)
    + " FROM measured",
    "std_scale": f"WITH {MEASURED} SELECT job_id, "
    + ", ".join(
        f"round(\"{c}\" / (SELECT CASE WHEN stddev_pop(\"{c}\") > 0 THEN stddev_pop(\"{c}\") ELSE 1 END FROM measured), 6) AS \"{c}\""
        for c in MEASURES)
    + " FROM measured",
    "normalized_vectors": """WITH long AS (
          SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings)
        SELECT vec_id, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM long""",
    "error_reasons": f"""WITH {PREPARED}, r AS (SELECT job_id, list_filter([
          CASE WHEN regexp_matches(lower(title || ' ' || description), 'money|earn|link|click|home|remote')
            THEN 'contains terms that may resemble scam or remote-work language' END,
          CASE WHEN {sql_normalised('company_profile')} = '' THEN 'missing company profile' END,
          CASE WHEN {sql_normalised('requirements')} = '' THEN 'missing requirements text' END,
          CASE WHEN length(description) < 400 THEN 'short description' END,
          CASE WHEN has_company_logo = 0 THEN 'no company logo' END], lambda x: x IS NOT NULL) AS l FROM prepared)
        SELECT job_id, CASE WHEN len(l) = 0 THEN 'likely reflects subtler text or category patterns learned by the model'
          ELSE array_to_string(l[1:3], '; ') END AS reasons FROM r""",
}
