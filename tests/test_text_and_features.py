import math

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from corpaudit.functions import numbers, text as tx
from corpaudit.operators import counterfactual, errors, features, postings
from corpaudit.operators.textfeatures import TfIdf, term_counts, vector_entries, vocabulary, with_tokens


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(column).collect()]


def test_normalise_knows_unicode_blanks(spark):
    given = ["a  B", "  A b\x1c\nc ", None, "", "  \t"]
    assert values(spark, given, tx.normalise(F.col("t"))) == ["a b", "a b c", "", "", ""]


def test_word_count_and_slug(spark):
    assert values(spark, ["a  b c ", "", None], tx.word_count(F.col("t"))) == [3, 0, 0]
    assert values(spark, ["--A b/C__"], tx.slugify(F.col("t"))) == ["a_b_c"]


def test_combined_text_keeps_blanks_of_missing_fields(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(tx.combine([F.col(c) for c in "xyz"])).first()[0] == "a  c"


def test_rounding_and_ratios(spark):
    row = spark.range(1).select(
        numbers.half_even(F.lit(2.5)), numbers.ratio(F.lit(1), F.lit(0)), numbers.ratio_or_zero(F.lit(1), F.lit(0)),
        numbers.percent_text(F.lit(0.0484)),
    ).first()
    assert list(row) == [2.0, None, 0.0, "4.84%"]


def test_stop_words_are_sparks(spark):
    assert tx.ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_terms_tf_and_vocabulary(spark):
    df = spark.createDataFrame([(1, "red red fox"), (2, "red hen the"), (3, ""), (4, None)], "id long, t string")
    counts = {(r["id"], r["term"]): r["tf"] for r in term_counts(with_tokens(df, "t"), ["id"]).collect()}
    assert counts[(1, "red")] == 2 and counts[(1, "red red")] == 1 and (2, "the") not in counts
    vocab = vocabulary(with_tokens(df, "t"), min_df=2).collect()
    assert [(r["term"], r["df"], r["cf"]) for r in vocab] == [("red", 2, 3)]


def test_tfidf_formula(spark):
    df = spark.createDataFrame([(1, "red red fox"), (2, "red fox fox"), (3, "red")], "id long, t string")
    model = TfIdf("t", "v", min_df=2).fit(df)
    got = {(r["id"], r["term"]): r["weight"] for r in vector_entries(model.transform(df), ["id"], "v", model.terms).collect()}
    idf = {"red": math.log(4 / 4) + 1, "fox": math.log(4 / 3) + 1, "red fox": math.log(4 / 3) + 1}
    raw = {"red": (1 + math.log(2)) * idf["red"], "fox": idf["fox"], "red fox": idf["red fox"]}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    for term, weight in raw.items():
        assert got[(1, term)] == pytest.approx(weight / norm)
    assert got[(3, "red")] == pytest.approx(1.0)


def test_unknown_category_and_constant_column(spark):
    roles = features.Roles("id", "label", (), ("c",), ("flag",))
    train = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, "", None)], "id long, c string, flag int")
    fitted = features.FeatureSet("metadata_only", roles).fit(train)
    assert fitted.names() == ["categorical__c_missing", "categorical__c_x", "categorical__c_y", "numeric__flag"]
    new = spark.createDataFrame([(9, "z", None)], "id long, c string, flag int")
    assert list(fitted.transform(new).first()["features"].toArray()) == [0, 0, 0, 1]


def posting(spark, **changes):
    base = dict(job_id=1, title="T", company_profile=None, description="d", requirements=None, benefits="b c",
                salary_range=None, location="l", department=None, fraudulent=1, has_company_logo=0)
    return postings.prepared(spark.createDataFrame([{**base, **changes}], (
        "job_id long, title string, company_profile string, description string, requirements string, benefits string,"
        "salary_range string, location string, department string, fraudulent int, has_company_logo int")))


def test_prepared_and_counterfactuals(spark):
    row = posting(spark).first()
    assert (row["has_benefits"], row["has_company_profile"], row["benefits_word_count"]) == (1, 0, 2)
    bare = counterfactual.remove_credibility(posting(spark)).first()
    assert (bare["benefits"], bare["has_benefits"], bare["benefits_length"], bare["combined_text"]) == ("", 0, 0, "T  d  ")
    rich = counterfactual.add_generic_credibility(posting(spark)).first()
    assert rich["company_profile"] == counterfactual.GENERIC_PROFILE and rich["benefits"] == "b c"
    assert rich["company_profile_length"] == len(counterfactual.GENERIC_PROFILE)


def test_missing_target_fails_before_any_job(spark):
    with pytest.raises(ValueError, match="Missing target column"):
        postings.prepared(spark.createDataFrame([(1,)], "job_id long"))


def test_reasons_stop_at_three(spark):
    reasons = posting(spark, description="earn money").select(errors.error_reasons()).first()[0]
    assert reasons.split("; ") == [errors.REASON_TERMS, errors.REASON_NO_PROFILE, errors.REASON_NO_REQUIREMENTS]


def test_length_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 11)], "job_id long, n long")
    got = {r["job_id"]: r["length_bucket"] for r in errors.length_buckets(df, ["n"], ["job_id"]).collect()}
    assert [got[i] for i in range(1, 11)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    same = df.withColumn("n", F.lit(5))
    assert errors.length_buckets(same, ["n"], ["job_id"]).count() == 0


def test_groups_share_their_parts(spark, monkeypatch):
    """What several groups have in common is fitted once, and made once per row, with the vectors of groups on their own."""
    roles = features.Roles("id", "label", ("body",), ("c",), ("flag",), ("n",))
    df = spark.createDataFrame(
        [(1, "red fox red", "x", 1, 4), (2, "red hen", "y", None, 0), (3, "fox hen owl", None, 0, 9), (4, None, "x", 1, None)],
        "id long, body string, c string, flag int, n int")
    fits, plain = [], features.TfIdf.fit
    monkeypatch.setattr(features.TfIdf, "fit", lambda self, rows: fits.append(1) or plain(self, rows))
    shared = features.SharedParts()
    groups = {g: features.FeatureSet(g, roles, "body").fit(df, shared) for g in features.FEATURE_GROUPS}
    assert len(fits) == 1
    got = {r["id"]: r for r in features.transform_groups(df, groups).collect()}
    measured = {r["id"]: r for r in features.transform_groups(df, groups).select(
        "id", *[F.struct(features.vector_width(g).alias("width"), features.filled_entries(g).alias("filled")).alias(g) for g in groups]).collect()}
    for name, fitted in groups.items():
        alone = features.FeatureSet(name, roles, "body").fit(df)
        assert alone.names() == fitted.names()
        for r in alone.transform(df).collect():
            own = r["features"].toArray()
            assert list(got[r["id"]][name].toArray()) == list(own)
            assert tuple(measured[r["id"]][name]) == (len(own), int((own != 0).sum()))


def test_fits_leave_only_scores_in_the_checkpoint_folder(spark):
    """Training vectors are deleted after the fits, and texts that no model reads aren't written again."""
    import os
    from urllib.parse import urlparse

    from corpaudit.operators import models
    from corpaudit.session import checkpointed

    checkpointed(spark.range(1))
    folder = urlparse(spark.sparkContext.getCheckpointDir()).path

    def tables():
        return {d for d in os.listdir(folder) if d.startswith("rdd-")}

    words = F.when(F.col("id") % 5 == 0, "wire money urgent cash").otherwise("steady office engineer team")
    df = spark.range(120).select(
        F.col("id").alias("job_id"), words.alias("combined_text"), (F.col("id") % 5 == 0).cast("int").alias("fraudulent"),
        F.lit("unread").alias("description"), (F.col("id") % 3).cast("int").alias("has_questions"),
        F.when(F.col("id") % 4 == 1, "test").otherwise("train").alias("part"),
    )
    specs = [
        models.ModelSpec("svm", models.LINEAR_SVM, "text_only", max_iter=10),
        models.ModelSpec("log", models.LOGISTIC, "text_plus_credibility", max_iter=10),
        models.ModelSpec("again", models.LINEAR_SVM, "text_only", max_iter=10),
    ]
    assert models.model_inputs(df, specs, ["job_id"]).columns == ["job_id", "combined_text", "has_questions"]
    before = tables()
    scored, fitted = models.evaluate_split(df, specs)
    assert len(tables() - before) == 2  # scores of both feature groups
    assert scored.count() == 90 and set(fitted) == {"svm", "log", "again"}
    before = tables()
    labelled = df.withColumn("label", F.col("fraudulent"))
    assert models.fit(specs[0], labelled).score(labelled, ["job_id"]).count() == 120
    assert tables() == before
