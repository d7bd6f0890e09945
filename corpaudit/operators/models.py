"""Fitting and scoring classifiers with Spark ML."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from corpaudit.functions.text import readable_feature
from corpaudit.operators.features import FeatureSet, FittedFeatures, SharedParts, filled_entries
from corpaudit.operators.metrics import binary_metrics
from corpaudit.operators.splits import stratified_folds
from corpaudit.session import checkpointed, dropped

MAJORITY = "majority"
LINEAR_SVM = "linear_svm"
LOGISTIC = "logistic_regression"
NAIVE_BAYES = "complement_naive_bayes"
FOREST = "random_forest"
# The studies' limits of solver passes. Fits are meant to end by tolerance.
MAX_ITER = {LINEAR_SVM: 5000, LOGISTIC: 2000}
#: Measured: ending at 3e-5 leaves the SVM objective within 3e-4 of its value at 1e-5.
TOLERANCE = 3e-5
#: Filled entries of training vectors that a task of a solver's pass takes, about. Smaller pieces cost more than they work.
PIECE_ENTRIES = 2_000_000
#: Rows up to which independent fits run side by side. Every fit holds tables of its own, and larger ones fill all cores alone.
SIDE_BY_SIDE = 200_000
FeatureKey = tuple[str, int, str]


@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str
    feature_group: str = "all"
    balanced: bool = True
    max_text_features: int = 10000
    scaling: str = "std"
    smoothing: float = 1.0
    trees: int = 250
    max_iter: int | None = None
    inverse_regularisation: float = 1.0

    @property
    def passes(self) -> int:
        return self.max_iter if self.max_iter is not None else MAX_ITER.get(self.kind, 0)

    @property
    def threshold(self) -> float:
        """Where the estimator itself would flag: margins at 0, probabilities at one half."""
        return 0.0 if self.kind in (LINEAR_SVM, LOGISTIC) else 0.5


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``n / (2 n_c)`` per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class.
    total, classes = F.sum("n").over(Window.partitionBy()), F.count(F.lit(1)).over(Window.partitionBy())
    return counts.select(label, "n", (total / (classes * F.col("n"))).alias("weight"))


def majority_class(df: DataFrame, label: str = "label") -> DataFrame:
    """The most frequent label and its share; ties to the smaller label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("majority_label"),
        (F.max("n") / F.sum("n")).alias("majority_class_accuracy"),
    )


def _weighted(train: DataFrame, balanced: bool) -> tuple[DataFrame, float]:
    """``train`` with column ``weight`` and the sum of the weights."""
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = float(sum(counts.values()))
    if not balanced:
        return train.withColumn("weight", F.lit(1.0)), total
    weight = reduce(
        lambda expr, item: F.when(F.col("label") == item[0], F.lit(total / (len(counts) * item[1]))).otherwise(expr),
        counts.items(), F.lit(1.0),
    )
    return train.withColumn("weight", weight), total


def _estimator(spec: ModelSpec, weight_sum: float, seed: int):
    columns = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    # Spark ML averages the loss over the weights; the reference sums it and scales by C.
    penalty = 1.0 / (spec.inverse_regularisation * weight_sum)
    if spec.kind == LINEAR_SVM:
        return LinearSVC(
            maxIter=spec.passes, tol=TOLERANCE, regParam=penalty, standardization=False, threshold=0.0, **columns
        )
    if spec.kind == LOGISTIC:
        return LogisticRegression(
            maxIter=spec.passes, tol=TOLERANCE, regParam=penalty, standardization=False, **columns
        )
    if spec.kind == NAIVE_BAYES:
        return NaiveBayes(modelType="complement", smoothing=spec.smoothing, featuresCol="features", labelCol="label")
    if spec.kind == FOREST:
        # Rows remember their node in every tree: otherwise all trees are sent to every task of every pass.
        return RandomForestClassifier(
            numTrees=spec.trees, minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxDepth=30, seed=seed,
            cacheNodeIds=True, **columns
        )
    raise ValueError(f"Unknown model: {spec.kind}")


@dataclass
class FittedModel:
    spec: ModelSpec
    features: FittedFeatures | None
    model: object
    constant: float = 0.0

    @property
    def objectives(self) -> list[float]:
        """The objective after every pass of an iterative solver."""
        if self.spec.kind not in MAX_ITER or self.model is None:
            return []
        summary = self.model.summary() if self.spec.kind == LINEAR_SVM else self.model.summary
        return list(summary.objectiveHistory)

    @property
    def converged(self) -> bool:
        """Whether the solver ended by tolerance, below its limit of passes."""
        return self.spec.kind not in MAX_ITER or len(self.objectives) - 1 < self.spec.passes

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and ``score``: margin of linear models, else probability of the positive class."""
        if self.features is None:
            return df.select(*keep, F.lit(self.constant).alias("score"))
        return self.score_vectors(self.features.transform(df), keep)

    def score_vectors(self, vectors: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The same for rows that carry ``features`` already."""
        if self.model is None:
            return vectors.select(*keep, F.lit(self.constant).alias("score"))
        scored = self.model.transform(vectors)
        column = "rawPrediction" if self.spec.kind in (LINEAR_SVM, LOGISTIC) else "probability"
        return scored.select(*keep, vector_to_array(column)[1].alias("score"))

    def coefficients(self, spark) -> DataFrame:
        """Named coefficients of a linear model, one row per feature."""
        rows = list(zip(self.features.names(), (float(c) for c in self.model.coefficients.toArray())))
        return spark.createDataFrame(rows, "feature string, coefficient double").withColumn(
            "feature", readable_feature(F.col("feature"))
        )


def _feature_set(spec: ModelSpec) -> FeatureSet:
    return FeatureSet(spec.feature_group, max_text_features=spec.max_text_features, scaling=spec.scaling)


def _fit_vectors(spec: ModelSpec, features: FittedFeatures | None, vectors: DataFrame, seed: int) -> FittedModel:
    """Fit on rows of ``label`` and ``features``."""
    if spec.kind == MAJORITY:
        return FittedModel(spec, features, None, float(majority_class(vectors).first()["majority_label"]))
    weighted, weight_sum = _weighted(vectors, spec.balanced)
    fitted = FittedModel(spec, features, _estimator(spec, weight_sum, seed).fit(weighted))
    if not fitted.converged:
        warnings.warn(f"{spec.name}: stopped at {spec.passes} passes before it reached its tolerance", stacklevel=2)
    return fitted


def fit(spec: ModelSpec, train: DataFrame, seed: int = 42) -> FittedModel:
    """Fit on ``train`` with columns ``label`` and the posting columns of the spec's feature group."""
    if spec.kind == MAJORITY:
        return _fit_vectors(spec, None, train, seed)
    features = _feature_set(spec).fit(train)
    with _feature_table(features, train) as vectors:
        return _fit_vectors(spec, features, vectors, seed)


@contextmanager
def _feature_table(features: FittedFeatures, train: DataFrame) -> Iterator[DataFrame]:
    """Training vectors written once: every pass of a solver ships its plan, so the plan is kept short. Deleted after the fits.

    A solver makes hundreds of passes, so the table's pieces are merged up to ``PIECE_ENTRIES``: their number follows the
    entries there are, and a table that is in larger pieces already stays as it is.
    """
    labelled = train.filter(F.col("label").isNotNull())
    table = checkpointed(features.transform(labelled).select("label", "features"))
    try:
        entries = table.agg(F.sum(filled_entries("features").cast("long"))).first()[0] or 0
        yield table.coalesce(max(1, math.ceil(entries / PIECE_ENTRIES)))
    finally:
        dropped(table)


def model_inputs(df: DataFrame, specs: Sequence[ModelSpec], keep: Sequence[str]) -> DataFrame:
    """``keep`` and the columns that the specs' features are made of; texts that no model reads are left out."""
    wanted = {*keep, *(c for spec in specs for c in _feature_set(spec).inputs(df))}
    return df.select(*[c for c in df.columns if c in wanted])


def fit_and_score(
    train: DataFrame, test: DataFrame, specs: Sequence[ModelSpec], keep: Sequence[str], seed: int = 42
) -> tuple[DataFrame, dict[str, FittedModel]]:
    """Every spec fitted on ``train`` and its scores of ``test``: ``model``, ``threshold``, ``keep``, ``score``.

    Specs with the same inputs share one feature table, and feature groups what they have in common. The scores are written once, so that nothing
    read from them fits a model again.
    """
    sharing: dict[FeatureKey, list[ModelSpec]] = {}
    for spec in specs:
        sharing.setdefault((spec.feature_group, spec.max_text_features, spec.scaling), []).append(spec)

    shared = SharedParts()
    threads = side_by_side(train) if len(specs) > 1 else 1

    def one(group: list[ModelSpec]):
        features = _feature_set(group[0]).fit(train, shared)
        with _feature_table(features, train) as vectors:
            models = in_parallel([lambda s=s: _fit_vectors(s, features, vectors, seed) for s in group], threads)
        held_out = features.transform(test).select(*keep, "features")
        if len(models) > 1:
            held_out.persist()
        scored = union_all([
            model.score_vectors(held_out, keep).select(
                F.lit(model.spec.name).alias("model"), F.lit(model.spec.threshold).alias("threshold"), *keep, "score"
            )
            for model in models
        ])
        written = checkpointed(scored)
        held_out.unpersist()
        return written, models

    done = in_parallel([lambda g=g: one(g) for g in sharing.values()], threads)
    return union_all([scored for scored, _ in done]), {m.spec.name: m for _, models in done for m in models}


def top_coefficients(fitted: FittedModel, spark, top: int = 25) -> DataFrame:
    """The strongest features of either sign, ties by name."""
    table = fitted.coefficients(spark)
    fake = table.orderBy(F.desc("coefficient"), "feature").limit(top).withColumn("direction", F.lit("Fake"))
    real = table.orderBy("coefficient", "feature").limit(top).withColumn("direction", F.lit("Real"))
    return fake.unionByName(real).select(
        "direction", "feature", "coefficient", F.abs("coefficient").alias("abs_coefficient"),
        F.substring("feature", 1, 55).alias("short_feature"),
    )


def in_parallel(tasks: Sequence[Callable[[], DataFrame]], threads: int = 4) -> list[DataFrame]:
    """Independent fits submitted from a few driver threads, so that small jobs overlap."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(lambda task: task(), tasks))


def side_by_side(df: DataFrame, threads: int = 4) -> int:
    """How many independent fits on ``df`` run at once."""
    return threads if df.count() <= SIDE_BY_SIDE else 1


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def evaluate_split(
    parts: DataFrame, specs: Sequence[ModelSpec], key: str = "job_id", label: str = "fraudulent",
    keep: Sequence[str] = (), seed: int = 42,
) -> tuple[DataFrame, dict[str, FittedModel]]:
    """Fit each spec on the 'train' rows and score the 'test' rows: ``model``, key, label, score, ``keep``."""
    named = parts.withColumn("label", F.col(label).cast("int"))
    named = model_inputs(named, specs, [key, "label", "part", *keep]).persist()
    train, test = named.filter(F.col("part") == "train"), named.filter(F.col("part") == "test")
    scored = fit_and_score(train, test, specs, [key, "label", *keep], seed)
    named.unpersist()
    return scored


def out_of_fold(
    df: DataFrame, specs: Sequence[ModelSpec], key: str = "job_id", label: str = "fraudulent",
    folds: int = 5, seed: int = 42,
) -> DataFrame:
    """Every row scored once per model, by the model that did not see its fold."""
    folded = stratified_folds(df, key, label, folds, seed).withColumn("label", F.col(label).cast("int"))
    folded = model_inputs(folded, specs, [key, "label", "fold"]).persist()

    def one(fold: int) -> DataFrame:
        train, held_out = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        return fit_and_score(train, held_out, specs, [key, "label", "fold"], seed)[0]

    scored = union_all(in_parallel([lambda f=f: one(f) for f in range(folds)], side_by_side(folded, 2)))
    folded.unpersist()
    return scored


# Metric names of the cross-validation tables.
CV_METRICS = {
    "accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy", "roc_auc": "roc_auc",
    "average_precision": "average_precision", "precision_fake": "fake_precision",
    "recall_fake": "fake_recall", "f1_fake": "fake_f1",
}


def fold_metrics(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Metrics per model and fold; each model flags at its own threshold."""
    return binary_metrics(scored, [*by, "threshold", "fold"], F.col("threshold")).drop("threshold")


def cv_summary(per_fold: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population deviation over folds."""
    columns = []
    for name, column in CV_METRICS.items():
        columns += [F.avg(column).alias(f"{name}_mean"), F.stddev_pop(column).alias(f"{name}_std")]
    return per_fold.groupBy(*by).agg(*columns)
