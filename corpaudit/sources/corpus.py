"""Reading labelled corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpaudit.roles import POSTING_ROLES, Roles


def read_corpus(
    spark: SparkSession,
    path: str,
    roles: Roles = POSTING_ROLES,
    schema: T.StructType | None = None,
    source_format: str | None = None,
) -> DataFrame:
    """A labelled table from CSV (quoted, multi-line) or Parquet, target column checked.

    A multi-line CSV file cannot be split, so one file is one task: convert large corpora to
    Parquet once and read those.
    """
    source_format = source_format or ("csv" if path.endswith(".csv") else "parquet")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if source_format == "csv":
        options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False}
        if schema is None:
            options["inferSchema"] = True
        df = reader.options(**options).csv(path)
    else:
        df = reader.format(source_format).load(path)
    return roles.require_target(df)


def side_by_side(datasets: dict[str, DataFrame]) -> DataFrame:
    """Several named datasets as one, with a ``dataset`` column."""
    tagged = [df.withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
