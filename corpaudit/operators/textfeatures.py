"""Tokens, vocabulary and TF-IDF.

A document stays one row: its terms are counted inside the row, so only the vocabulary needs a
shuffle. The vocabulary is bounded by ``max_features``; everything sized by it may sit on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window, functions as F, types as T

from corpaudit.functions.text import ENGLISH_STOP_WORDS, unigrams_and_bigrams, without, words

MODEL_FEATURES = 8000
PAIR_FEATURES = 18000


def with_tokens(
    df: DataFrame, text: str, tokens: str = "tokens", stop_words: Sequence[str] | None = ENGLISH_STOP_WORDS,
    ngrams: int = 2,
) -> DataFrame:
    """Adds the terms of each text: words, less stop words, then with pairs of neighbours."""
    terms = words(F.col(text))
    if stop_words:
        terms = without(terms, stop_words)
    df = df.withColumn(tokens, terms)
    return df.withColumn(tokens, unigrams_and_bigrams(F.col(tokens))) if ngrams == 2 else df


def term_counts(df: DataFrame, keep: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """One row per document and distinct term, ``tf`` counted inside the row.

    The sorted terms of a document form runs; a run's length is its count. No shuffle. The outer
    form of ``inline`` keeps the optimizer from inferring a filter on the array, which would inline
    the sort into every comparison.
    """
    ordered = df.select(*keep, F.sort_array(tokens).alias("_sorted"))
    starts = ordered.withColumn(
        "_starts",
        F.filter(
            F.sequence(F.lit(0), F.size("_sorted") - 1),
            lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)),
        ),
    )
    runs = F.transform(
        "_starts",
        lambda start, run: F.struct(
            F.get("_sorted", start).alias("term"),
            (F.coalesce(F.get("_starts", run + 1), F.size("_sorted")) - start).cast("long").alias("tf"),
        ),
    )
    counted = starts.select(*keep, runs.alias("_runs")).select(*keep, F.inline_outer("_runs"))
    return counted.filter(F.col("term").isNotNull())


def vocabulary(
    df: DataFrame, tokens: str = "tokens", min_df: int = 2, max_df: float = 1.0, max_features: int = MODEL_FEATURES,
) -> DataFrame:
    """Terms in ``min_df`` documents or more and at most a share ``max_df`` of them, the most frequent
    ``max_features`` by total count, ties by term: ``term``, ``df``, ``cf``, ``n_docs``."""
    counted = term_counts(df, [], tokens).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )
    # One row.
    total = df.agg(F.count(F.lit(1)).alias("n_docs"))
    return (
        counted.filter(F.col("df") >= min_df)
        .crossJoin(F.broadcast(total))
        .filter(F.col("df") <= F.lit(float(max_df)) * F.col("n_docs"))
        .orderBy(F.desc("cf"), "term")
        .limit(max_features)
    )


@dataclass
class TfIdf:
    """Sublinear, smoothed, L2-normalised TF-IDF: ``(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)``."""

    text: str
    output: str = "text_vector"
    min_df: int = 2
    max_df: float = 1.0
    max_features: int = MODEL_FEATURES
    stop_words: Sequence[str] = field(default_factory=lambda: ENGLISH_STOP_WORDS)

    def fit(self, df: DataFrame) -> "TfIdfModel":
        tokenised = with_tokens(df.select(self.text), self.text, "tokens", self.stop_words)
        chosen = vocabulary(tokenised, "tokens", self.min_df, self.max_df, self.max_features)
        idf = F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0
        # At most max_features rows.
        rows = sorted((r["term"], r["idf"]) for r in chosen.select("term", idf.alias("idf")).collect())
        return TfIdfModel(self, [term for term, _ in rows], [weight for _, weight in rows])


@dataclass
class TfIdfModel:
    settings: TfIdf
    terms: list[str]
    idf: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the sparse vector of every row. A map: no shuffle, all in the JVM."""
        out = self.settings.output
        if not self.terms:
            raise ValueError("no term passes the document frequency limits")
        counter = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_tokens", outputCol="_counts")
        counted = counter.transform(with_tokens(df, self.settings.text, "_tokens", self.settings.stop_words))
        sublinear = sparse_vector(
            F.col("_raw.indices"), F.transform("_raw.values", lambda tf: F.log(tf) + 1.0), len(self.terms)
        )
        weighted = counted.withColumn("_raw", F.unwrap_udt("_counts")).withColumn("_tf", sublinear)
        weighted = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_weighted"
        ).transform(weighted)
        normalised = Normalizer(p=2.0, inputCol="_weighted", outputCol=out).transform(weighted)
        return normalised.select(*df.columns, out)


VECTOR_WRAPPER = T.StructType([T.StructField("v", VectorUDT())])


def sparse_vector(indices, values, size: int):
    """A sparse vector column from index and value arrays, built by the JVM's own reader of vectors."""
    fields = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        indices.alias("indices"), values.alias("values"),
    )
    return F.from_json(F.to_json(F.struct(fields.alias("v"))), VECTOR_WRAPPER)["v"]


def vector_entries(df: DataFrame, keep: Sequence[str], vector: str, terms: Sequence[str]) -> DataFrame:
    """Sparse vectors in long form: ``keep``, ``term``, ``weight``."""
    names = df.sparkSession.createDataFrame(list(enumerate(terms)), "index int, term string")
    raw = df.select(*keep, F.unwrap_udt(vector).alias("_raw"))
    long = raw.select(*keep, F.inline_outer(F.arrays_zip(F.col("_raw.indices").alias("index"), F.col("_raw.values").alias("weight"))))
    # The vocabulary: at most max_features rows.
    return long.join(F.broadcast(names), "index").select(*keep, "term", "weight")


def tfidf(df: DataFrame, key: str, text: str, **settings) -> DataFrame:
    """TF-IDF of every document in long form."""
    model = TfIdf(text, **settings).fit(df)
    return vector_entries(model.transform(df.select(key, text)), [key], model.settings.output, model.terms)


def top_terms(weights: DataFrame, group: str, weight: str = "weight", top: int = 18) -> DataFrame:
    """The heaviest terms per group, joined by ', ' in falling order; no zero weights."""
    order = Window.partitionBy(group).orderBy(F.desc(weight), "term")
    first = (
        weights.filter(F.col(weight) > 0)
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= top)
    )
    # top rows per group
    return first.groupBy(group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_place", "term"))), lambda t: t["term"]), ", "
        ).alias("top_terms")
    )
