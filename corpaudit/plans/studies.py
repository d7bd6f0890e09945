"""The composite studies. Each takes a prepared posting table and returns DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from threading import Lock

from pyspark.sql import DataFrame, functions as F

from corpaudit.operators import counterfactual, duplicates, errors, metrics, sampling, splits, thresholds, topics
from corpaudit.operators.components import clusters, threshold_sweep
from corpaudit.operators.models import (
    FOREST, LINEAR_SVM, LOGISTIC, MAJORITY, NAIVE_BAYES, ModelSpec, cv_summary, evaluate_split,
    fit, fold_metrics, in_parallel, model_inputs, out_of_fold, side_by_side, top_coefficients, union_all,
)
from corpaudit.operators.neighbours import knn_pairs, pair_details, review_pairs, top_pairs
from corpaudit.operators.reports import drop_vs_baseline, lowest_per_group, repeat_summary
from corpaudit.roles import POSTING_ROLES
from corpaudit.session import checkpointed
from corpaudit.sources import results

KEY, TARGET = POSTING_ROLES.key, POSTING_ROLES.target

# Seeds, names and grids of the studies.
STUDY_SEED = 42
LEAKAGE_SEEDS = (7, 13, 23, 31, 43)
NEIGHBOURS = 7
NEAR_THRESHOLD = 0.98
NEAR_THRESHOLDS = (0.95, 0.98, 0.99)
AUDIT_CANDIDATES, NEAR_CANDIDATES, LEAKAGE_CANDIDATES = 100, 75, 30

FULL_SVM = ModelSpec("linear_svm", LINEAR_SVM)
LEAKAGE_MODELS = (
    ModelSpec("Linear SVM", LINEAR_SVM, "text_only", max_text_features=8000),
    ModelSpec("Logistic Regression", LOGISTIC, "text_only", max_text_features=8000),
    ModelSpec("Complement Naive Bayes", NAIVE_BAYES, "text_only", max_text_features=8000),
)
COMPARED_MODELS = (
    ModelSpec("Dummy majority baseline", MAJORITY),
    ModelSpec("Logistic Regression balanced", LOGISTIC, max_text_features=6000, scaling="maxabs"),
    ModelSpec("Linear SVM balanced", LINEAR_SVM, max_text_features=6000, scaling="maxabs"),
    ModelSpec("Complement Naive Bayes text only", NAIVE_BAYES, "text_only", max_text_features=6000, smoothing=0.5),
    ModelSpec("Random Forest metadata only", FOREST, "metadata_only", scaling="maxabs"),
)
WEIGHTED_MODELS = (
    ModelSpec("Logistic Regression unweighted", LOGISTIC, balanced=False, max_text_features=6000, scaling="maxabs"),
    ModelSpec("Logistic Regression balanced", LOGISTIC, max_text_features=6000, scaling="maxabs"),
    ModelSpec("Linear SVM unweighted", LINEAR_SVM, balanced=False, max_text_features=6000, scaling="maxabs"),
    ModelSpec("Linear SVM balanced", LINEAR_SVM, max_text_features=6000, scaling="maxabs"),
)
SHORTCUT_GROUPS = {
    "All features": "all",
    "Text only": "text_only",
    "Text + metadata + length, no credibility flags": "text_no_credibility",
    "Metadata + flags + lengths only": "metadata_only",
    "Shortcut features only: flags + lengths": "shortcuts_only",
    "Credibility flags only": "credibility_flags_only",
    "Length features only": "length_only",
}
ABLATION_GROUPS = {
    "All features": "all",
    "Text only": "text_only",
    "Metadata only": "metadata_only",
    "Credibility binary only": "credibility_flags_only",
    "Length numeric only": "length_only",
    "Text plus credibility binary": "text_plus_credibility",
}
TRAINING_VARIANTS = (
    ("Observed imbalance, unweighted", sampling.STRATEGIES[0], False),
    ("Observed imbalance, class_weight=balanced", sampling.STRATEGIES[0], True),
    ("Undersampled 1:1, unweighted", sampling.STRATEGIES[1], False),
    ("Oversampled 1:1, unweighted", sampling.STRATEGIES[2], False),
    ("Oversampled 20% fake, unweighted", sampling.STRATEGIES[3], False),
)
PROFILE_MEANS = {
    "score": "mean_score_for_fake",
    "has_company_logo": "company_logo_rate",
    "has_company_profile": "company_profile_rate",
    "has_questions": "questions_rate",
    "has_salary_range": "salary_range_rate",
    "has_benefits": "benefits_rate",
    "description_length": "mean_description_length",
    "requirements_length": "mean_requirements_length",
    "company_profile_length": "mean_company_profile_length",
    "benefits_length": "mean_benefits_length",
}
CONTRAST_FEATURES = ("has_company_logo", "has_company_profile", "has_questions", "has_salary_range", "has_benefits")
SUBGROUP_FEATURES = (
    "employment_type", "required_experience", "required_education", "telecommuting", "has_company_logo",
    "has_company_profile", "has_salary_range", "has_benefits", "industry", "function",
)


def holdout(df: DataFrame, seed: int = STUDY_SEED) -> DataFrame:
    """The stratified 75/25 split most studies share."""
    return splits.stratified_split(df, KEY, TARGET, [seed]).drop("seed")


def holdout_scores(df: DataFrame, spec: ModelSpec = FULL_SVM, seed: int = STUDY_SEED):
    """Fit on the training side; the fitted model and its scores with the test rows' columns."""
    parts = holdout(df, seed).withColumn("label", F.col(TARGET).cast("int")).persist()
    fitted = fit(spec, parts.filter(F.col("part") == "train"), seed)
    test = parts.filter(F.col("part") == "test")
    keep = [c for c in test.columns if c not in ("score", "combined_text", "part")]
    return fitted, test, fitted.score(test, keep)


def leakage_by_seed(df: DataFrame, groups: Sequence[str], seeds: Sequence[int] = LEAKAGE_SEEDS) -> DataFrame:
    """Test rows of random splits whose group also trains: one shuffle per group column for all seeds."""
    marks = {seed: f"_test_{place}" for place, seed in enumerate(dict.fromkeys(seeds))}
    slim = splits.seed_marks(df.select(KEY, TARGET, *groups), KEY, TARGET, list(marks), list(marks.values()))
    written = checkpointed(slim.select(*groups, *marks.values()))
    tables = [
        duplicates.leakage_by_mark(written, group, marks).withColumn("cluster_type", F.lit(group)) for group in groups
    ]
    return union_all(tables)


def split_robustness(df: DataFrame, spec: ModelSpec = FULL_SVM, seed: int = STUDY_SEED) -> DataFrame:
    """One model under the random, the duplicate-group and the key-order split."""
    protocols = {
        "random_stratified_split": holdout(df, seed),
        "duplicate_group_split": splits.group_split(df, "content_signature", TARGET, seed, AUDIT_CANDIDATES),
        "job_id_order_split": splits.order_split(df, KEY),
    }
    return _compare_splits(protocols, spec, seed)


def _compare_splits(protocols: dict[str, DataFrame], spec: ModelSpec, seed: int) -> DataFrame:
    def one(name: str, parts: DataFrame):
        scored, _ = evaluate_split(parts, [spec], KEY, TARGET, seed=seed)
        stats = splits.split_stats(parts, TARGET)
        return (
            scored.select(F.lit(name).alias("split_name"), KEY, "label", "score"),
            stats.withColumn("split_name", F.lit(name)),
        )

    threads = side_by_side(next(iter(protocols.values()))) if len(protocols) > 1 else 1
    done = in_parallel([lambda n=n, p=p: one(n, p) for n, p in protocols.items()], threads)
    scores = union_all([scored for scored, _ in done])
    stats = union_all([stat for _, stat in done])
    return stats.join(metrics.binary_metrics(scores, ["split_name"], spec.threshold), "split_name")


def feature_group_study(df: DataFrame, groups: dict[str, str], seed: int = STUDY_SEED) -> DataFrame:
    """One SVM per feature group on the shared holdout."""
    specs = [ModelSpec(label, LINEAR_SVM, group) for label, group in groups.items()]
    scored, _ = evaluate_split(holdout(df, seed), specs, KEY, TARGET, seed=seed)
    labels = F.create_map(*[F.lit(x) for item in groups.items() for x in item])
    return metrics.binary_metrics(scored, ["model"]).withColumn("feature_group", labels[F.col("model")])


def shortcut_audit(df: DataFrame, seed: int = STUDY_SEED) -> DataFrame:
    return feature_group_study(df, SHORTCUT_GROUPS, seed)


def feature_ablation(df: DataFrame, seed: int = STUDY_SEED) -> DataFrame:
    return feature_group_study(df, ABLATION_GROUPS, seed)


def counterfactual_study(df: DataFrame, spec: ModelSpec = FULL_SVM, seed: int = STUDY_SEED) -> dict[str, DataFrame]:
    """Metrics and score shifts of the fitted model on edited test rows."""
    fitted, test, _ = holdout_scores(df, spec, seed)
    scored = {name: checkpointed(fitted.score(rows, [KEY, "label"])) for name, rows in counterfactual.scenarios(test).items()}
    original = scored[counterfactual.SCENARIOS[0]]
    tagged = union_all([rows.withColumn("scenario", F.lit(name)) for name, rows in scored.items()])
    shifts = [
        metrics.score_shift(original, rows, KEY).withColumn("scenario", F.lit(name)) for name, rows in scored.items()
    ]
    return {
        "counterfactual_credibility_test": metrics.binary_metrics(tagged, ["scenario"]),
        "counterfactual_credibility_score_shifts": union_all(shifts),
    }


def training_distribution(df: DataFrame, seed: int = STUDY_SEED, spec: ModelSpec = FULL_SVM) -> DataFrame:
    """The same model trained on resampled or reweighted rows, tested on the untouched holdout."""
    parts = holdout(df, seed).withColumn("label", F.col(TARGET).cast("int"))
    parts = model_inputs(parts, [spec], [KEY, "label", "part"]).persist()
    train, test = parts.filter(F.col("part") == "train"), parts.filter(F.col("part") == "test")

    def one(label: str, strategy: str, balanced: bool):
        rows = sampling.resample_training(train, KEY, "label", strategy, seed)
        fitted = fit(ModelSpec(label, spec.kind, spec.feature_group, balanced), rows, seed)
        size = rows.agg(
            F.lit(label).alias("model"), F.lit(strategy).alias("sampling_strategy"),
            F.lit("balanced" if balanced else "none").alias("class_weight"),
            F.count(F.lit(1)).alias("training_rows"), F.avg("label").alias("training_fake_rate"),
        )
        return checkpointed(fitted.score(test, [KEY, "label"]).withColumn("model", F.lit(label))), size

    done = in_parallel([lambda v=v: one(*v) for v in TRAINING_VARIANTS], side_by_side(train))
    scores, sizes = union_all([s for s, _ in done]), union_all([s for _, s in done])
    return sizes.join(metrics.binary_metrics(scores, ["model"]), "model")


def label_scarcity(
    df: DataFrame, seed: int = STUDY_SEED, counts: Sequence[int] = sampling.SCARCITY_COUNTS, repeats: int = 3,
    spec: ModelSpec = FULL_SVM,
) -> DataFrame:
    """Means and deviations of the holdout metrics by number of positive labels in training."""
    parts = holdout(df, seed).withColumn("label", F.col(TARGET).cast("int"))
    parts = model_inputs(parts, [spec], [KEY, "label", "part"]).persist()
    train, test = parts.filter(F.col("part") == "train"), parts.filter(F.col("part") == "test")
    samples = sampling.label_scarcity_samples(train, KEY, "label", counts, repeats, seed).persist()
    runs = ["fake_labels_available", "repeat"]
    sizes = samples.groupBy(*runs).agg(F.avg("label").alias("training_fake_rate"))

    def one(count: int, repeat: int) -> DataFrame:
        rows = samples.filter((F.col(runs[0]) == count) & (F.col(runs[1]) == repeat))
        scored = fit(spec, rows, seed).score(test, [KEY, "label"])
        return checkpointed(scored.select("*", F.lit(count).alias(runs[0]), F.lit(repeat).alias(runs[1])))

    # One row per run.
    wanted = [(r[runs[0]], r[runs[1]]) for r in sizes.select(*runs).collect()]
    scores = union_all(in_parallel([lambda w=w: one(*w) for w in sorted(wanted)], side_by_side(train)))
    per_run = metrics.binary_metrics(scores, runs).join(sizes, runs)
    averaged = ("average_precision", "fake_precision", "fake_recall", "fake_f1")
    spread = [c for m in averaged for c in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    return per_run.groupBy("fake_labels_available").agg(
        F.count("repeat").alias("repeats"), F.avg("training_fake_rate").alias("training_fake_rate_mean"), *spread,
        F.avg("false_positives").alias("false_positives_mean"), F.avg("false_negatives").alias("false_negatives_mean"),
    )


def imbalance_study(df: DataFrame, seed: int = STUDY_SEED) -> dict[str, DataFrame]:
    """The whole imbalance run: everything after the fit reads the score table only."""
    _, _, scored = holdout_scores(df, FULL_SVM, seed)
    scored = scored.withColumn("id", F.col(KEY)).persist()
    grid = thresholds.threshold_grid(scored)
    grouped = errors.with_groups(scored, names=errors.HOLDOUT_GROUPS)
    samples = sampling.prevalence_samples(scored, seed=seed)
    return {
        "prevalence_stress_test_summary": sampling.prevalence_summary(samples),
        "review_budget_analysis": thresholds.review_budget(scored),
        "expanded_threshold_metric_grid": grid,
        "expanded_cost_sensitivity_grid": thresholds.cost_grid(grid),
        "expanded_cost_sensitivity_threshold_selection": thresholds.cost_selection(grid),
        "training_distribution_experiment": training_distribution(df, seed),
        "feature_group_ablation": feature_ablation(df, seed),
        "label_scarcity_experiment_summary": label_scarcity(df, seed),
        "holdout_error_group_profile": errors.error_profile(grouped, PROFILE_MEANS),
        "holdout_error_binary_feature_contrasts": errors.error_contrasts(
            grouped, CONTRAST_FEATURES, errors.HOLDOUT_GROUPS
        ),
    }


def robustness_audit(df: DataFrame, seed: int = STUDY_SEED) -> dict[str, DataFrame]:
    """The whole robustness audit."""
    groups = duplicates.duplicate_groups(df, "content_signature", TARGET)
    _, _, scored = holdout_scores(df, FULL_SVM, seed)
    scored = scored.persist()
    return {
        "duplicate_signature_summary": duplicates.duplicate_summary(groups),
        "random_split_duplicate_leakage_summary": duplicates.leakage(holdout(df, seed), "content_signature"),
        "split_robustness_comparison": split_robustness(df, seed=seed),
        "shortcut_feature_audit": shortcut_audit(df, seed),
        **counterfactual_study(df, seed=seed),
        "subgroup_robustness_metrics": errors.subgroup_metrics(scored, SUBGROUP_FEATURES),
        "top_case_studies": errors.error_cases(scored),
    }


def near_duplicate_pairs(
    df: DataFrame, text: str = "combined_text", k: int | None = NEIGHBOURS, min_similarity: float = -1.0,
    dimensions: int = topics.EMBEDDING_DIMENSIONS, max_features: int = topics.PAIR_FEATURES,
) -> DataFrame:
    """Nearest-neighbour pairs of texts in the reduced TF-IDF space."""
    embedded = checkpointed(topics.svd_embedding(df, KEY, text, dimensions, max_features))
    return knn_pairs(embedded, KEY, "embedding", k, min_similarity)


def near_duplicate_audit(
    df: DataFrame, seed: int = STUDY_SEED, spec: ModelSpec = FULL_SVM, pairs: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Pairs, threshold sweep, and the model under a near-duplicate group split."""
    if pairs is None:
        pairs = near_duplicate_pairs(df, min_similarity=min(NEAR_THRESHOLDS)).persist()
    random_parts = holdout(df, seed)
    sweep = threshold_sweep(random_parts.select(KEY, TARGET, "part"), KEY, TARGET, pairs, NEAR_THRESHOLDS)
    clustered = clusters(df, KEY, pairs, NEAR_THRESHOLD, "near_duplicate_cluster_98")
    grouped = splits.group_split(clustered, "near_duplicate_cluster_98", TARGET, seed, NEAR_CANDIDATES)
    protocols = {"random_stratified_split": random_parts, "near_duplicate_group_split_98": grouped}
    details = {"job_id": F.col(KEY), "fraudulent": F.col(TARGET), "title": F.substring("title", 1, 90)}
    return {
        "near_duplicate_top_pairs": pair_details(top_pairs(pairs, 100), df, KEY, details),
        "near_duplicate_cluster_summary": sweep,
        "near_duplicate_split_comparison": _compare_splits(protocols, spec, seed),
    }


def archetypes(df: DataFrame, seed: int = STUDY_SEED, spec: ModelSpec = FULL_SVM) -> dict[str, DataFrame]:
    """Topics of the positives, recall per topic, and the least suspected cases of each."""
    positives = df.filter(F.col(TARGET) == 1)
    model = topics.fit_topics(positives, KEY, "combined_text")
    terms, assigned = model.top_terms(), model.assign()
    parts = holdout(df, seed)
    scored, _ = evaluate_split(parts, [spec], KEY, TARGET, keep=["title", "combined_text"], seed=seed)
    test_positives = scored.filter(F.col("label") == 1)
    detection = topics.detection_by_topic(test_positives, assigned, KEY)
    # One row per topic.
    detection = detection.join(F.broadcast(terms), "topic", "left").withColumnRenamed("topic", "fake_archetype")
    cases = test_positives.join(assigned, KEY).withColumnRenamed("topic", "fake_archetype")
    examples = lowest_per_group(cases, "fake_archetype", "score", KEY).select(
        "fake_archetype", KEY, "title", F.col("score").alias("score_for_fake"),
        (F.col("score") >= 0).cast("int").alias("predicted"), F.substring("combined_text", 1, 300).alias("text_snippet"),
    )
    return {
        "fake_archetype_top_terms": terms.withColumnRenamed("topic", "fake_archetype"),
        "fake_archetype_detection_summary": detection,
        "fake_archetype_low_score_examples": examples,
    }


def leakage_runs(
    df: DataFrame, seeds: Sequence[int] = LEAKAGE_SEEDS, specs: Sequence[ModelSpec] = LEAKAGE_MODELS,
    protocols: Sequence[str] = splits.PROTOCOLS, ledger: str | None = None, name: str = "repeated_split_model_results",
) -> DataFrame:
    """Metrics of every model under every protocol and seed. ``df`` carries both group columns.

    With a ``ledger`` folder, each finished run (a protocol and seed) is committed there under ``name``; a study that
    broke off fits only the runs that are missing, and the result is read from the ledger. A ledger belongs to one table
    and one set of models: runs of others are not told apart.
    """
    runs = ["model", "split_protocol", "seed"]
    wanted = df.sparkSession.createDataFrame(
        [(p, int(s)) for s in seeds for p in protocols], f"{runs[1]} string, {runs[2]} int"
    )

    def one(seed: int, protocol: str) -> DataFrame:
        parts = splits.split_by_protocol(df, protocol, seed, KEY, TARGET, candidates=LEAKAGE_CANDIDATES)
        scored, _ = evaluate_split(parts, specs, KEY, TARGET)
        tags = [F.lit(protocol).alias(runs[1]), F.lit(seed).alias(runs[2])]
        stats = splits.split_stats(parts, TARGET).select("*", *tags)
        table = metrics.binary_metrics(scored.select("*", *tags), [*runs, "threshold"], F.col("threshold"))
        # A row per model.
        return checkpointed(table.drop("threshold").join(F.broadcast(stats), runs[1:]))

    threads = side_by_side(df)
    if ledger is None:
        return union_all(in_parallel([lambda s=s, p=p: one(s, p) for s in seeds for p in protocols], threads))

    commits = Lock()  # one writer at a time changes the table

    def committed(seed: int, protocol: str) -> None:
        table = one(seed, protocol)
        with commits:
            results.append_run(table, ledger, name, runs[1:])

    # One row per run.
    missing = results.missing_runs(wanted, ledger, name, runs[1:]).collect()
    in_parallel([lambda r=r: committed(r[runs[2]], r[runs[1]]) for r in missing], threads)
    done = results.read_table(df.sparkSession, ledger, name)
    return done.join(F.broadcast(wanted), runs[1:], "left_semi")


def leakage_study(
    df: DataFrame, seeds: Sequence[int] = LEAKAGE_SEEDS, ledger: str | None = None
) -> dict[str, DataFrame]:
    """Near-template clusters, leakage of random splits, and what leakage-free splits cost each model.

    ``ledger``: a shared folder that keeps finished runs (see :func:`leakage_runs`).
    """
    pairs = near_duplicate_pairs(df, min_similarity=NEAR_THRESHOLD).persist()
    near = splits.PROTOCOLS[2].replace("near_template_group", "near_template_cluster")
    clustered = clusters(df, KEY, pairs, NEAR_THRESHOLD, near).persist()
    kinds = ["exact_signature", near]
    by_seed = leakage_by_seed(clustered, kinds, seeds)
    summary = union_all(
        [duplicates.cluster_summary(clustered, kind, TARGET).withColumn("cluster_type", F.lit(kind)) for kind in kinds]
    )
    table = leakage_runs(clustered, seeds, ledger=ledger).persist()
    details = {
        "job_id": F.col(KEY), "fraudulent": F.col(TARGET),
        "title": F.substring("title", 1, 120), "description": F.substring("description", 1, 260),
    }
    return {
        "cluster_summary": summary,
        "random_split_leakage_by_seed": by_seed,
        "random_split_leakage_summary": duplicates.leakage_summary(by_seed),
        "near_template_manual_review_candidates": pair_details(review_pairs(pairs), df, KEY, details),
        "near_template_top_pairs": top_pairs(pairs, 250),
        "repeated_split_model_results": table,
        "repeated_split_model_summary": repeat_summary(table),
        "split_performance_drop_summary": drop_vs_baseline(table),
    }


def cross_validation(df: DataFrame, specs: Sequence[ModelSpec] = COMPARED_MODELS, folds: int = 5) -> dict[str, DataFrame]:
    """Out-of-fold scores and the metrics' mean and deviation over folds."""
    scored = out_of_fold(df, specs, KEY, TARGET, folds, STUDY_SEED).persist()
    return {"out_of_fold": scored, "cv_model_comparison": cv_summary(fold_metrics(scored))}


def interpretation(df: DataFrame, spec: ModelSpec = COMPARED_MODELS[2]) -> DataFrame:
    """Strongest coefficients of the model fitted on all rows."""
    labelled = df.withColumn("label", F.col(TARGET).cast("int"))
    return top_coefficients(fit(spec, labelled), df.sparkSession)


