"""Fitted models and the composite studies over the posting view."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpaudit.operators import components, splits, topics
from corpaudit.operators.features import FEATURE_GROUPS, FeatureSet, SharedParts, filled_entries, transform_groups, vector_width
from corpaudit.operators.models import evaluate_split, model_inputs
from corpaudit.plans import studies
from workloads.views import postings, rounded

KEY, TARGET = "job_id", "fraudulent"


def corpus(spark, sf_dir):
    """The posting columns of the studies, read once by all fits of a query."""
    return postings(spark, sf_dir).drop("n_chars", "salary_range").persist()


def inputs(spark, sf_dir, *keep):
    """Key, label, every model's inputs and ``keep`` only, read once by all fits of a query."""
    return model_inputs(postings(spark, sf_dir), [studies.FULL_SVM], [KEY, TARGET, *keep]).persist()


def scored_by(spec):
    def query(spark, sf_dir):
        parts = splits.stratified_split(inputs(spark, sf_dir), KEY, TARGET, [studies.STUDY_SEED])
        scored, _ = evaluate_split(parts, [spec], KEY, TARGET)
        return rounded(scored)

    return query


def scores(spark, sf_dir):
    """One margin or probability per row for every model of the comparison."""
    parts = splits.stratified_split(inputs(spark, sf_dir), KEY, TARGET, [studies.STUDY_SEED])
    scored, _ = evaluate_split(parts, studies.LEAKAGE_MODELS, KEY, TARGET)
    return rounded(scored)


def evaluated(spark, sf_dir):
    return rounded(studies._compare_splits(
        {"random_stratified_split": studies.holdout(inputs(spark, sf_dir))}, studies.FULL_SVM, studies.STUDY_SEED
    ))


def feature_groups(spark, sf_dir):
    """Vector width and filled entries of every named feature group."""
    df, shared = inputs(spark, sf_dir), SharedParts()
    fitted = {name: FeatureSet(name).fit(df, shared) for name in FEATURE_GROUPS}
    vectors = transform_groups(df, fitted)
    found = vectors.agg(*[
        F.struct(
            F.lit(name).alias("feature_group"), F.max(vector_width(name)).alias("width"), F.sum(filled_entries(name)).alias("filled")
        ).alias(name)
        for name in fitted
    ])
    return found.select(F.inline(F.array(*fitted)))


def coefficients(spark, sf_dir):
    return rounded(studies.interpretation(inputs(spark, sf_dir)))


def oof_predictions(spark, sf_dir):
    return rounded(studies.cross_validation(inputs(spark, sf_dir), studies.COMPARED_MODELS[2:3])["out_of_fold"])


def cv_results(spark, sf_dir):
    return rounded(studies.cross_validation(inputs(spark, sf_dir))["cv_model_comparison"])


def weighted_comparison(spark, sf_dir):
    return rounded(studies.cross_validation(inputs(spark, sf_dir), studies.WEIGHTED_MODELS)["cv_model_comparison"])


def split_robustness(spark, sf_dir):
    return rounded(studies.split_robustness(inputs(spark, sf_dir, "content_signature")))


def shortcut_audit(spark, sf_dir):
    return rounded(studies.shortcut_audit(inputs(spark, sf_dir)))


def feature_ablation(spark, sf_dir):
    return rounded(studies.feature_ablation(inputs(spark, sf_dir)))


def counterfactual_metrics(spark, sf_dir):
    return rounded(studies.counterfactual_study(corpus(spark, sf_dir))["counterfactual_credibility_test"])


def counterfactual_shifts(spark, sf_dir):
    return rounded(studies.counterfactual_study(corpus(spark, sf_dir))["counterfactual_credibility_score_shifts"])


def training_distribution(spark, sf_dir):
    return rounded(studies.training_distribution(inputs(spark, sf_dir)))


def label_scarcity(spark, sf_dir):
    return rounded(studies.label_scarcity(inputs(spark, sf_dir)))


def near_duplicate_audit(spark, sf_dir):
    return rounded(studies.near_duplicate_audit(inputs(spark, sf_dir, "title"))["near_duplicate_split_comparison"])


def near_clustered(spark, sf_dir):
    """Postings with both group columns of the leakage protocols."""
    df = postings(spark, sf_dir).select(KEY, TARGET, "exact_signature", "combined_text").persist()
    pairs = studies.near_duplicate_pairs(df, min_similarity=studies.NEAR_THRESHOLD)
    return components.clusters(df, KEY, pairs, studies.NEAR_THRESHOLD, "near_template_cluster_098").persist()


def leakage_matrix(spark, sf_dir):
    return rounded(studies.leakage_runs(near_clustered(spark, sf_dir)))


def fitted_topics(spark, sf_dir):
    positives = inputs(spark, sf_dir).filter(F.col(TARGET) == 1)
    return topics.fit_topics(positives, KEY, "combined_text")


def topic_weights(spark, sf_dir):
    return rounded(fitted_topics(spark, sf_dir).term_weights())


def topic_terms(spark, sf_dir):
    return fitted_topics(spark, sf_dir).top_terms()


def topic_assign(spark, sf_dir):
    return fitted_topics(spark, sf_dir).assign()


def archetype_detection(spark, sf_dir):
    return rounded(studies.archetypes(inputs(spark, sf_dir, "title"))["fake_archetype_detection_summary"])


QUERIES = {
    "model_linear_svm": scored_by(studies.COMPARED_MODELS[2]),
    "model_logreg": scored_by(studies.COMPARED_MODELS[1]),
    "model_cnb": scored_by(studies.COMPARED_MODELS[3]),
    "model_random_forest": scored_by(studies.COMPARED_MODELS[4]),
    "scores": scores, "evaluate_split": evaluated, "feature_groups": feature_groups,
    "top_coefficients": coefficients, "oof_predictions": oof_predictions, "cv_results": cv_results,
    "weighted_comparison": weighted_comparison, "split_robustness": split_robustness,
    "shortcut_audit": shortcut_audit, "feature_ablation": feature_ablation,
    "counterfactual_metrics": counterfactual_metrics, "counterfactual_shifts": counterfactual_shifts,
    "training_distribution": training_distribution, "label_scarcity": label_scarcity,
    "near_duplicate_audit": near_duplicate_audit, "leakage_matrix": leakage_matrix,
    "topics": topic_weights, "topic_terms": topic_terms, "topic_assign": topic_assign,
    "archetype_detection": archetype_detection,
}
ORACLES: dict[str, str] = {}
