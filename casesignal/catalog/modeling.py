"""Training and scoring on the case tables.

The estimators' defaults are the published sizes; depth 30, MLlib's limit,
stands for the reference's unlimited depth. The single forests have them and
are grown on histograms by ``bagged``. The
boosted queries take the folds, labels, rate, depth and rounds (ROUNDS,
LABEL_ROUNDS) as published; ``forest_per_label`` takes
LABEL_TREES for each label, grown to the end. README has measured times.
"""

from functools import lru_cache, partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from casesignal.catalog import adapters as a
from casesignal.catalog.features import v1, v2
from casesignal.catalog.registry import query
from casesignal.operators import aggregate, evaluate, labels, splits
from casesignal.plans import signals as plan
from casesignal.plans import bagged, boost, train
from casesignal.session import scratch_path, stored
from casesignal.sources.tables import load_pipeline, save_model

ROUNDS, LABEL_ROUNDS, LABEL_TREES = 800, 1200, 500

_ID, _Y = "PRIMARYID", "y_multiADR"
_NOT_FEATURES = (_ID, _Y, "ADR_count")


def _v1_split(spark, sf):
    cases = stored(v1(spark, sf), "cases")
    return splits.stratified_holdout(cases, _ID, [_Y], 42)


def _fit_v1(spark, sf, estimator, fit=partial(train.fit_and_score, scaling="std")):
    split = _v1_split(spark, sf)
    rows, test = split.where("is_test = 0"), split.where("is_test = 1")
    features = train.choose_features(rows, (*_NOT_FEATURES, "is_test"))
    return fit(rows, test, _ID, _Y, features, estimator)


@query("logistic_scores")
def logistic_scores(spark, sf):
    """Balanced logistic regression, scores of the held-out cases."""
    _, scored, _ = _fit_v1(spark, sf, train.logistic())
    return evaluate.apply_threshold(scored, "score", 0.5)


@query("logistic_coefficients")
def logistic_coefficients(spark, sf):
    model, _, done = _fit_v1(spark, sf, train.logistic())
    return train.importance_table(spark, train.coefficients(model.stages[-1], done.names), "lr_coef")


@query("forest_report")
def forest_report(spark, sf):
    """Random forest, classification report on the held-out cases."""
    _, scored, _ = _fit_v1(spark, sf, train.forest(), train.grow_and_score)
    predicted = evaluate.apply_threshold(scored, "score", 0.5)
    return evaluate.classification_report(evaluate.confusion(predicted, _Y, "pred"))


@query("pipeline_roundtrip", "SELECT 0.0::DOUBLE AS max_difference")
def pipeline_roundtrip(spark, sf):
    """Saved and loaded pipeline: the largest change of a score of raw case rows."""
    model, _, _ = _fit_v1(spark, sf, train.logistic())
    path = scratch_path(spark, "model")
    save_model(model, path)
    before = train.scores(model, v1(spark, sf), [_ID])
    after = train.scores(load_pipeline(path), v1(spark, sf), [_ID]).withColumnRenamed("score", "again")
    return before.join(after, _ID).agg(F.max(F.abs(F.col("score") - F.col("again"))).alias("max_difference"))


@query("logistic_gradient", "SELECT 0.0::DOUBLE AS max_gradient")
def logistic_gradient(spark, sf):
    """Gradient of the penalised loss at the fitted coefficients, per unit of weight."""
    split = _v1_split(spark, sf).where("is_test = 0")
    features = train.choose_features(split, (*_NOT_FEATURES, "is_test"))
    done = train.fit_preparation(split, features, scaling="std")
    vectors = train.prepared(split, done, [_ID, _Y])
    model = train.fit(train.logistic(), vectors, _Y)
    rows = train.weighted(vectors, _Y, "balanced").select(_Y, train.WEIGHT, vector_to_array(train.FEATURES).alias("x"))
    beta = [float(b) for b in model.coefficients]
    margin = F.aggregate(F.zip_with("x", F.lit(beta), lambda a, b: a * b), F.lit(model.intercept), lambda s, v: s + v)
    off = F.col(train.WEIGHT) * (1 / (1 + F.exp(-margin)) - F.col(_Y))
    sums = rows.withColumn("off", off).agg(
        F.sum(train.WEIGHT).alias("w"), F.array(*[F.sum(F.col("off") * F.col("x")[j]) for j in range(len(beta))]).alias("g")
    )
    worst = F.array_max(F.zip_with("g", F.lit(beta), lambda g, b: F.abs(g + b)))
    return sums.select(F.round(worst / F.col("w"), 3).alias("max_gradient"))


def _cross_validated(spark, sf):
    """The five folds' models; the queries on one table of a session share one fit."""
    return _cross_validated_once(spark.sparkContext.applicationId, spark, sf)


@lru_cache(maxsize=4)
def _cross_validated_once(_session, spark, sf):
    cases = stored(v2(spark, sf), "cases")
    folded = splits.stratified_folds(cases, _ID, [_Y], 42, folds=5)
    features = train.choose_features(folded, (*_NOT_FEATURES, "fold"))
    return train.cross_validate_boosted(folded, _ID, _Y, "fold", 5, features, boost.Settings(rounds=ROUNDS))


@query("boosted_cv_metrics")
def boosted_cv_metrics(spark, sf):
    """Boosted trees, metrics of each fold."""
    return _cross_validated(spark, sf).metrics


@query("boosted_oof_report")
def boosted_oof_report(spark, sf):
    """Report over all out-of-fold predictions."""
    return train.oof_summary(_cross_validated(spark, sf), _Y)[2]


@query("boosted_importances")
def boosted_importances(spark, sf):
    return _cross_validated(spark, sf).importances


def _aligned(spark, sf):
    x = plan.aligned_features(
        a.demo(spark, sf), a.drug(spark, sf), a.reac(spark, sf), a.dim(spark, sf),
        ordinal="ordinal", synonyms=a.SYNONYMS,
    )
    x = stored(x, "aligned")
    # Labels are counted on the cases that have features.
    pairs = labels.long_labels(a.reac(spark, sf), _ID, "PT").join(x.select(_ID).distinct(), _ID, "left_semi")
    return x, stored(pairs, "labels")


_NUMBERS = ("AGE", "mol_weight", "logP", "TPSA", "HBD", "HBA")
_X_FEATURES = train.FeatureSet(_NUMBERS, ("SEX", "drug_mapped", "ATC"))
_LABEL_FEATURES = train.FeatureSet(_NUMBERS, ("SEX", "YEAR", "QTR", "drug_mapped", "ATC", "mechanism_tags"))


@query("boosted_per_label")
def boosted_per_label(spark, sf):
    """One boosted model per top label, thresholds from the grid."""
    x, pairs = _aligned(spark, sf)
    parts = splits.nested(x, _ID, 42)
    names = labels.label_names(pairs, _ID, "PT", 50)
    settings = boost.Settings(rounds=LABEL_ROUNDS, depth=5, rate=0.05)
    return train.boosted_per_label(parts, pairs, _ID, "PT", names, "part", _LABEL_FEATURES, settings).predictions


@query("forest_per_label")
def forest_per_label(spark, sf):
    """One forest per top label on numbers and name bits, stepped thresholds."""
    from casesignal.operators import prep

    x, pairs = _aligned(spark, sf)
    with_bits = prep.bits_by_value(x, "drug_mapped", nbits=1024)
    parts = splits.nested(with_bits, _ID, 42)
    names = labels.label_names(pairs, _ID, "PT", 30)
    features = train.FeatureSet(_X_FEATURES.numeric, (), "bits", 1024)
    _, predictions = train.forest_per_label(
        parts, pairs, _ID, "PT", names, "part", features, bagged.Settings(trees=LABEL_TREES)
    )
    return evaluate.micro_macro_f1(predictions, "y", "pred", "label")


@query("forest_multi_vs_single")
def forest_multi_vs_single(spark, sf):
    """Tuned on validation rows, refitted, binary metrics of the test rows."""
    x, pairs = _aligned(spark, sf)
    y = labels.multi_vs_single(pairs, _ID, "PT", 30).select(_ID, "y")
    parts = splits.nested(x.join(y, _ID), _ID, 42, ["y"])
    tuned = train.tune_and_refit(
        parts, _ID, "y", "part", _X_FEATURES, train.forest(trees=500, min_leaf=1),
        grown=True, fill="zero",
    )
    return evaluate.binary_metrics(tuned.predictions, "y", "pred").withColumn(
        "threshold", F.lit(tuned.threshold)
    )


@query("forest_top_importances")
def forest_top_importances(spark, sf):
    model, _, _ = _fit_v1(spark, sf, train.forest(), train.grow_and_score)
    table = train.importance_table(spark, model.importances())
    return aggregate.top_rows(table, 30, ["importance"], ["feature"])
