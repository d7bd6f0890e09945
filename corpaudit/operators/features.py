"""Tabular features and the assembly of named feature groups."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from corpaudit.operators.profile import long_form
from corpaudit.operators.textfeatures import TfIdf
from corpaudit.roles import POSTING_ROLES, Roles

MISSING = "missing"


@dataclass(frozen=True)
class FeatureGroup:
    text: bool = False
    categorical: bool = False
    binary: bool = False
    lengths: bool = False


# Which inputs each named group has.
FEATURE_GROUPS = {
    "all": FeatureGroup(True, True, True, True),
    "text_only": FeatureGroup(text=True),
    "metadata_only": FeatureGroup(False, True, True, True),
    "shortcuts_only": FeatureGroup(False, False, True, True),
    "credibility_flags_only": FeatureGroup(False, False, True, False),
    "length_only": FeatureGroup(False, False, False, True),
    "text_no_credibility": FeatureGroup(True, True, False, True),
    "text_plus_credibility": FeatureGroup(True, False, True, False),
}


def feature_columns(df: DataFrame, roles: Roles = POSTING_ROLES) -> DataFrame:
    """Which columns of a table a model would use, read from its schema."""
    rows = [(c, "categorical") for c in roles.present(df, roles.categorical)]
    rows += [(c, "numeric") for c in roles.discover_numeric(df)]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


def one_hot(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One-hot encoding in long form: the ones only. NULL counts as 'missing'."""
    filled = df.select(key, *[F.coalesce(F.col(c), F.lit(MISSING)).alias(c) for c in columns])
    long = long_form(filled, columns, [key], "column", "value")
    return long.select(key, F.concat_ws("_", "column", "value").alias("feature"), F.lit(1.0).alias("value"))


def _medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.median(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in columns}


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs replaced by the column's exact median. Meant for flags and lengths, with few distinct values."""
    return _imputed(df, _medians(df, columns))


def _imputed(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def _scales(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, float]:
    measure = {
        "maxabs": lambda c: F.max(F.abs(F.col(c))),
        # Partial deviations of a constant need not merge to exactly 0.
        "std": lambda c: F.when(F.min(c) < F.max(c), F.stddev_pop(F.col(c).cast("double"))),
    }[method]
    row = df.agg(*[measure(c).alias(c) for c in columns]).first()
    # A constant column is left as it is.
    return {c: float(row[c]) if row[c] else 1.0 for c in columns}


def scaled(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    """Columns divided by their largest absolute value ('maxabs') or population deviation ('std')."""
    return _scaled(df, _scales(df, columns, method))


def _scaled(df: DataFrame, scales: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(s) for c, s in scales.items()})


def l2_normalised(df: DataFrame, vector: str) -> DataFrame:
    """Array vectors divided by their length; a zero vector stays.

    The length is an argument next to the vector, not a name inside the per-element function, so the
    optimizer cannot move its computation into the loop.
    """
    squares = F.aggregate(F.col(vector), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    length = F.sqrt(squares)
    divisors = F.array_repeat(F.when(length == 0, 1.0).otherwise(length), F.size(vector))
    return df.withColumn(vector, F.zip_with(vector, divisors, lambda x, d: x.cast("double") / d))


def vector_width(vector: str) -> Column:
    """The size of a vector of Spark ML, which sparse ones name and dense ones have."""
    raw = F.unwrap_udt(vector)
    return F.coalesce(raw["size"], F.size(raw["values"]))


def filled_entries(vector: str) -> Column:
    """How many entries of a vector of Spark ML aren't 0, read from those it holds."""
    return F.size(F.filter(F.unwrap_udt(vector)["values"], lambda x: x != 0))


class SharedParts:
    """What feature groups fitted on the same rows have in common, each part fitted once. For fits of one table only."""

    def __init__(self):
        self._lock = threading.Lock()
        self._made: dict = {}

    def once(self, keys: Sequence, make: Callable[[list], Sequence]) -> list:
        """The parts of ``keys``; those that are missing are made together, in their order."""
        with self._lock:
            if missing := [k for k in keys if k not in self._made]:
                self._made.update(zip(missing, make(missing), strict=True))
            return [self._made[k] for k in keys]


@dataclass
class FeatureSet:
    """Estimator of the ``features`` vector of one feature group; all statistics from the rows it is fitted on."""

    group: str = "all"
    roles: Roles = POSTING_ROLES
    text: str = "combined_text"
    max_text_features: int = 10000
    scaling: str = "std"
    numeric: Sequence[str] | None = None

    def fit(self, train: DataFrame, shared: SharedParts | None = None) -> "FittedFeatures":
        parts, shared = self._parts(), shared or SharedParts()
        fitted = FittedFeatures(self)
        if parts.text:
            def text(_):
                return [TfIdf(self.text, "_text_vector", max_features=self.max_text_features).fit(train)]

            fitted.tfidf, = shared.once([("text", self.text, self.max_text_features)], text)
        if parts.categorical:
            fitted.categorical = self.roles.present(train, self.roles.categorical)
            (fitted.indexer, fitted.encoder), = shared.once(
                [("categorical", *fitted.categorical)], lambda _: [_encoder(train, fitted.categorical)])
        if numeric := self._numbers(train):
            def numbers(keys):
                columns = [c for _, _, c in keys]
                medians = _medians(train, columns)
                scales = _scales(_imputed(train.select(*columns), medians), columns, self.scaling)
                return [(medians[c], scales[c]) for c in columns]

            found = dict(zip(numeric, shared.once([("numeric", self.scaling, c) for c in numeric], numbers)))
            fitted.medians = {c: median for c, (median, _) in found.items()}
            fitted.scales = {c: scale for c, (_, scale) in found.items()}
        return fitted

    def inputs(self, df: DataFrame) -> list[str]:
        """The columns of ``df`` that the vector is made of."""
        parts = self._parts()
        return [
            *([self.text] if parts.text else []), *(self.roles.present(df, self.roles.categorical) if parts.categorical else []),
            *self._numbers(df),
        ]

    def _parts(self) -> FeatureGroup:
        if self.group not in FEATURE_GROUPS:
            raise ValueError(f"Unknown feature group: {self.group}")
        return FEATURE_GROUPS[self.group]

    def _numbers(self, df: DataFrame) -> list[str]:
        parts = self._parts()
        if not (parts.binary or parts.lengths):
            return []
        return list(self.numeric) if self.numeric is not None else [
            *(self.roles.present(df, self.roles.binary) if parts.binary else []),
            *(self.roles.present(df, self.roles.lengths) if parts.lengths else []),
        ]


def _encoder(train: DataFrame, columns: Sequence[str]):
    filled = train.select(*[_filled(c) for c in columns])
    indexed = [f"_{c}_index" for c in columns]
    # The unknown bucket is last and dropped, so an unseen value encodes as zeros.
    indexer = StringIndexer(
        inputCols=[f"_{c}_value" for c in columns], outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc",
    ).fit(filled)
    encoder = OneHotEncoder(
        inputCols=indexed, outputCols=[f"_{c}_onehot" for c in columns], dropLast=True,
    ).fit(indexer.transform(filled))
    return indexer, encoder


def _filled(column: str):
    # An encoder's category cannot be named '', and NULL was '' before.
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(MISSING)).alias(f"_{column}_value")


class FittedFeatures:
    def __init__(self, settings: FeatureSet):
        self.settings = settings
        self.tfidf = None
        self.categorical: list[str] = []
        self.indexer = None
        self.encoder = None
        self.medians: dict[str, float] = {}
        self.scales: dict[str, float] = {}

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``features``. A map over the rows."""
        return transform_groups(df, {"features": self})

    def names(self) -> list[str]:
        """Feature names in vector order, each with the prefix of its kind."""
        names = [f"text__{t}" for t in self.tfidf.terms] if self.tfidf else []
        if self.categorical:
            for column, labels in zip(self.categorical, self.indexer.labelsArray):
                names += [f"categorical__{column}_{value}" for value in labels]
        return names + [f"numeric__{c}" for c in self.medians]


def transform_groups(df: DataFrame, groups: Mapping[str, FittedFeatures]) -> DataFrame:
    """Adds a vector column per group, by name. A map over the rows; parts that groups share (``SharedParts``) are made
    once per row."""
    inputs: dict[str, list[str]] = {name: [] for name in groups}
    out, parts = df, {"tfidf": {}, "encoder": {}, "numeric": {}}

    def column_prefix(kind: str, part) -> tuple[str, bool]:
        """The prefix of a part's columns, and whether they have to be made."""
        known = parts[kind]
        new = part not in known
        return f"_{known.setdefault(part, len(known))}", new

    for name, group in groups.items():
        if group.tfidf is not None:
            prefix, new = column_prefix("tfidf", id(group.tfidf))
            if new:
                out = group.tfidf.transform(out).withColumnRenamed("_text_vector", f"{prefix}_text_vector")
            inputs[name].append(f"{prefix}_text_vector")
        if group.categorical:
            prefix, new = column_prefix("encoder", id(group.encoder))
            if new:
                out = out.select("*", *[_filled(c) for c in group.categorical])
                out = group.encoder.transform(group.indexer.transform(out))
                out = out.drop(*[f"_{c}_{kind}" for c in group.categorical for kind in ("value", "index")]).withColumnsRenamed(
                    {f"_{c}_onehot": f"{prefix}_{c}_onehot" for c in group.categorical})
            inputs[name] += [f"{prefix}_{c}_onehot" for c in group.categorical]
        scaled_columns = {}
        for c, median in group.medians.items():
            prefix, new = column_prefix("numeric", (c, median, group.scales[c]))
            if new:
                scaled_columns[f"{prefix}_scaled"] = F.coalesce(F.col(c).cast("double"), F.lit(median)) / F.lit(group.scales[c])
            inputs[name].append(f"{prefix}_scaled")
        if scaled_columns:
            out = out.withColumns(scaled_columns)
    for name in groups:
        out = VectorAssembler(inputCols=inputs[name], outputCol=name, handleInvalid="error").transform(out)
    return out.select(*df.columns, *groups)
