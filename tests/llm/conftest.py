import pytest

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text[, lang[, source]]) rows, with a column whose name clashes."""
    def make(rows, extra="n_words"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS).repartition(3)
        return df.selectExpr("*", f"'clash' AS {extra}") if extra else df
    return make
