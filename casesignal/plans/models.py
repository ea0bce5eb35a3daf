"""Model flows: from the stored tables of ``plans.pipeline`` to stored results.

Defaults are the published settings; every size is an argument.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from casesignal.operators import evaluate, labels, prep, splits, stats
from casesignal.operators.aggregate import top_rows
from casesignal.plans import boost, pipeline, signals, train
from casesignal.session import stored
from casesignal.sources.tables import cached_table, read_parquet, save_model, write_csv, write_parquet

_KEY, _Y = "PRIMARYID", "y_multiADR"
_NOT_FEATURES = (_KEY, _Y, "ADR_count")
# Properties and targets of the correlation step.
PROPERTIES = ("mol_weight", "logP", "TPSA", "HBD", "HBA")
TARGETS = ("n_reports", "mean_ADR_per_case", "unique_PT_count")


def run_correlations(spark: SparkSession, out: str) -> None:
    """Spearman correlations of the rolled-up exposures' properties."""
    rolled = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/rolled_up")
    props = [c for c in PROPERTIES if c in rolled.columns]
    write_csv(stats.spearman(rolled, props, [c for c in TARGETS if c in rolled.columns]), f"{out}/correlations")


def v1_features(df: DataFrame, candidates: Sequence[str], exclude: Sequence[str]) -> train.FeatureSet:
    """The candidates that exist, and of the other numbers those that are 0 or 1."""
    others = [c for c in prep.numeric_columns(df, (*exclude, *candidates))]
    marks = prep.binary_columns(df, others) if others else []
    return train.choose_features(df, exclude, [*candidates, *marks])


def run_case_models(spark: SparkSession, out: str, candidates: Sequence[str], *, seed: int = 42, max_iter: int = 2000, trees: int = 400, folds: int = 5, rounds: int = 800) -> None:
    """Logistic regression and forest on features v1, boosted trees on v2."""
    cases = read_parquet(spark, f"{out}/features_v1")
    split = stored(splits.stratified_holdout(cases, _KEY, [_Y], seed), "cases")
    rows, test = split.where("is_test = 0").drop("is_test"), split.where("is_test = 1").drop("is_test")
    features = v1_features(rows, candidates, _NOT_FEATURES)
    for name, estimator in (("logistic", train.logistic(max_iter=max_iter)), ("forest", train.forest(trees=trees))):
        model, scored, done = train.fit_and_score(rows, test, _KEY, _Y, features, estimator, scaling="std")
        predicted = evaluate.apply_threshold(scored, "score", 0.5)
        write_parquet(predicted, f"{out}/{name}/predictions")
        cells = evaluate.confusion(predicted, _Y, "pred")
        write_csv(evaluate.classification_report(cells), f"{out}/{name}/report")
        write_csv(evaluate.auc_and_ap(scored, _Y, "score"), f"{out}/{name}/areas")
        weights = train.coefficients if name == "logistic" else train.importances
        write_csv(train.importance_table(spark, weights(model.stages[-1], done.names)), f"{out}/{name}/features")
        save_model(model, f"{out}/{name}/model")
    v2 = stored(splits.stratified_folds(read_parquet(spark, f"{out}/features_v2"), _KEY, [_Y], seed, folds), "folds")
    features = train.choose_features(v2, (*_NOT_FEATURES, "fold"))
    cv = train.cross_validate_boosted(v2, _KEY, _Y, "fold", folds, features, boost.Settings(rounds=rounds))
    write_parquet(cv.nodes, f"{out}/boosted/nodes")
    write_parquet(cv.predictions, f"{out}/boosted/predictions")
    write_csv(cv.metrics, f"{out}/boosted/folds")
    write_csv(top_rows(cv.importances, 50, ["importance"], ["feature"]), f"{out}/boosted/features")


def _aligned(spark: SparkSession, root: str, compounds_csv: str) -> tuple[DataFrame, DataFrame]:
    """Feature rows, and the labels of the cases that have one."""
    t, dim = pipeline.read_clean(spark, root), pipeline.compounds(spark, compounds_csv)
    x = stored(signals.aligned_features(t["DEMO"], t["DRUG"], t["REAC"], dim), "aligned")
    pairs = labels.long_labels(t["REAC"], _KEY, "PT").join(x.select(_KEY).distinct(), _KEY, "left_semi")
    return x, stored(pairs, "labels")


def run_label_models(
    spark: SparkSession, root: str, compounds_csv: str, out: str, *, seed: int = 42, top_labels: int = 50,
    rounds: int = 1200, forest_labels: int = 30, trees: int = 500, nbits: int = 1024,
) -> None:
    """One boosted model and one forest for each of the most frequent labels."""
    x, pairs = _aligned(spark, root, compounds_csv)
    categories = [c for c in ("YEAR", "QTR", "mechanism_tags") if c in x.columns]
    x = x.withColumns({c: x[c].cast("string") for c in categories})
    numbers = [c for c in prep.numeric_columns(x, (_KEY,))]
    parts = stored(splits.nested(x, _KEY, seed), "parts")
    numeric, categorical = prep.usable_features(parts, numbers, categories)
    names = labels.label_names(pairs, _KEY, "PT", top_labels)
    boosted = train.boosted_per_label(
        parts, pairs, _KEY, "PT", names, "part", train.FeatureSet(tuple(numeric), tuple(categorical)),
        boost.Settings(rounds=rounds, depth=5, rate=0.05),
    )
    write_parquet(boosted.thresholds, f"{out}/boosted_labels/thresholds")
    write_parquet(boosted.predictions, f"{out}/boosted_labels/predictions")
    write_parquet(boosted.nodes, f"{out}/boosted_labels/nodes")
    # The bits of each name are made once per content of the name column.
    bits = cached_table(
        parts.select("drug_mapped").distinct(), "drug_mapped", f"{out}/cache", f"bits{nbits}",
        lambda d: prep.bits_by_value(d, "drug_mapped", nbits=nbits),
    )
    names = labels.label_names(pairs, _KEY, "PT", forest_labels)
    forests = train.train_per_label(
        parts.join(bits, "drug_mapped"), pairs, _KEY, "PT", names, "part",
        train.FeatureSet(tuple(numeric), (), "bits", nbits), train.forest(trees=trees, min_leaf=1),
        tuning="stepped", refit=True, fill="zero",
    )
    pipeline.write_label_models(forests, f"{out}/forest_labels")


def run_binary_model(spark: SparkSession, root: str, compounds_csv: str, out: str, *, seed: int = 42, top_labels: int = 30, trees: int = 500) -> None:
    """Several labels against one: tuned on validation rows, refitted, stored."""
    x, pairs = _aligned(spark, root, compounds_csv)
    y = labels.multi_vs_single(pairs, _KEY, "PT", top_labels).select(_KEY, "y")
    parts = stored(splits.nested(x.join(y, _KEY), _KEY, seed, ["y"]), "parts")
    categories = [c for c in ("SEX", "drug_mapped", "ATC") if c in parts.columns]
    numeric, categorical = prep.usable_features(parts, prep.numeric_columns(parts, (_KEY, "y")), categories)
    tuned = train.tune_and_refit(
        parts, _KEY, "y", "part", train.FeatureSet(tuple(numeric), tuple(categorical)),
        train.forest(trees=trees, min_leaf=1), fill="zero", encode="index",
    )
    pipeline.write_tuned(tuned, f"{out}/binary")
    write_csv(evaluate.binary_metrics(tuned.predictions, "y", "pred"), f"{out}/binary/metrics")
