"""Preparation, training and scoring on small separable data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casesignal.operators import evaluate, prep, splits
from casesignal.plans import train
from casesignal.sources.tables import load_pipeline, save_model


@pytest.fixture(scope="module")
def rows(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    return spark.range(400).select(
        "id",
        F.when(F.col("id") % 11 != 0, h * 10).alias("x"),
        (F.col("id") % 3).cast("double").alias("noise"),
        F.lit(None).cast("double").alias("nothing"),
        F.when(F.col("id") % 5 != 0, F.when(h > 0.5, "it's high").otherwise("low")).alias("kind"),
        (h > 0.6).cast("int").alias("y"),
    ).cache()


def test_choose_features(rows):
    chosen = train.choose_features(rows, ("id", "y"))
    assert chosen.numeric == ("x", "noise") and chosen.categorical == ("kind",)
    assert prep.binary_columns(rows, ["x", "noise", "y", "nothing"]) == ["y"]


def test_preparation_is_fitted_on_train(rows):
    low = rows.where("x < 5")
    done = train.fit_preparation(low, train.FeatureSet(("x", "noise"), ("kind",)), scaling="standard")
    assert done.names == ["x", "noise", "kind_low"]
    mean = low.agg(F.avg("x"), F.stddev_pop("x")).first()
    got = train.prepared(rows, done, ["id", "x"]).where("x IS NOT NULL").first()
    assert got["features"][0] == pytest.approx((got["x"] - mean[0]) / mean[1])


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, None), (8.0, "b"), (2.0, "a")], "v double, s string")
    assert prep.as_dict(prep.medians(df, ["v"])) == {"v": 2.5}
    assert prep.as_dict(prep.most_frequent(df, ["s"])) == {"s": "a"}
    constant = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert [r["v"] for r in prep.scale(constant, ["v"]).collect()] == [0.0, 0.0]
    assert [r["v"] for r in prep.scale(constant, ["v"], center=False).collect()] == [4.0, 4.0]
    hot = prep.one_hot(df, "s", ["a", "b"]).collect()
    assert [(r["s_a"], r["s_b"]) for r in hot] == [(0, 1), (1, 0), (0, 0), (0, 1), (1, 0)]


def test_wide_categories_by_index(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "b", 0), (2, None, 0), (3, "a", 0), (4, "new", 0)], "id int, s string, index int")
    index = prep.category_index(df.where("s <> 'new'"), "s")
    assert sorted(map(tuple, index.collect())) == [("a", 0), ("b", 1)]
    got = prep.one_hot_long(df, "s", index)
    assert got.columns == ["id", "s", "index", "s_index"]
    assert sorted((r.id, r.s_index) for r in got.collect()) == [(1, 1), (1, 1), (2, None), (3, 0), (4, None)]
    many = spark.range(50_000).select((F.col("id") * 7 % 50_000).alias("v"))
    assert prep.one_hot_long(many, "v").where("v != v_index").count() == 0
    assert prep.one_hot_long(df.limit(0), "s").collect() == []


def test_wide_category_equals_columns(rows, monkeypatch):
    """The sparse form gives the vector of a column for each value."""
    df = rows.withColumn("many", F.when(F.col("id") % 7 != 0, F.concat(F.lit("v"), F.col("id") % 40)))
    features = train.FeatureSet(("x",), ("kind", "many"))
    fitted = df.where("id < 300 AND id % 40 != 3")
    want = train.fit_preparation(fitted, features)
    monkeypatch.setattr(train, "WIDE", 10)
    done = train.fit_preparation(fitted, features)
    assert done.names == want.names and "many_v3" not in done.names
    vectors = [{r.id: r.features.toArray().tolist() for r in train.prepared(df, p, ["id"]).collect()} for p in (done, want)]
    assert vectors[0] == vectors[1] and len(vectors[0]) == 400


def test_a_category_of_100000_values_trains(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(100_000))
    df = spark.range(200_000).select("id", F.concat(F.lit("c"), h).alias("many"), (h < 40_000).cast("int").alias("y"), (h / 1e5).alias("x"))
    features = train.FeatureSet(("x",), ("many",))
    _, scored, done = train.fit_and_score(df, df.where("id < 1000"), "id", "y", features, train.logistic(max_iter=5), scaling="std")
    assert len(done.names) > 80_000
    assert evaluate.roc_auc(scored, "y", "score").first()["auc"] > 0.9


def test_safe_numeric(spark):
    df = spark.createDataFrame([("1", "1"), (None, "x"), ("2.5", "3")], "a string, b string")
    assert prep.safe_numeric(df, ["a", "b"]).dtypes == [("a", "double"), ("b", "string")]


def test_logistic_learns_and_reloads(spark, rows, tmp_path):
    split = splits.stratified_holdout(rows, "id", ["y"], 1)
    fit_rows, test = split.where("is_test = 0"), split.where("is_test = 1")
    features = train.FeatureSet(("x", "noise"), ("kind",))
    model, scored, done = train.fit_and_score(
        fit_rows, test, "id", "y", features, train.logistic(max_iter=50), scaling="std"
    )
    assert evaluate.roc_auc(scored, "y", "score").first()["auc"] > 0.9
    assert train.coefficients(model.stages[-1], done.names)[0][0] in ("x", "kind_it's high")
    save_model(model, str(tmp_path / "m"))
    again = train.scores(load_pipeline(str(tmp_path / "m")), test, ["id"])
    assert again.count() == test.count()


def test_logistic_solves_the_penalised_problem(rows):
    """The gradient of the weighted loss plus the penalty is zero."""
    features = train.FeatureSet(("x", "noise"), ("kind",))
    done = train.fit_preparation(rows, features, scaling="standard")
    vectors = train.prepared(rows, done, ["id", "y"])
    model = train.fit(train.logistic(c=0.5), vectors, "y", "balanced")
    got = train.weighted(vectors, "y", "balanced").collect()
    x = np.array([r["features"].toArray() for r in got])
    y, w = (np.array([r[c] for r in got], dtype=float) for c in ("y", train.WEIGHT))
    beta = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ beta + model.intercept)))
    assert np.abs(x.T @ (w * (p - y)) + beta / 0.5).max() < 1e-2 and abs((w * (p - y)).sum()) < 1e-2


def test_category_of_any_size(spark):
    df = spark.range(3000).select("id", (F.col("id") % 1000).cast("string").alias("code"), (F.col("id") % 1000 < 400).cast("int").alias("y"))
    features = train.FeatureSet((), ("code",))
    _, scored, _ = train.fit_and_score(df, df, "id", "y", features, train.forest(trees=3, depth=3, min_leaf=1), encode="index")
    assert evaluate.roc_auc(scored, "y", "score").first()["auc"] > 0.9


def test_cross_validation_covers_all_rows(rows):
    folded = splits.stratified_folds(rows, "id", ["y"], 1, folds=2)
    cv = train.cross_validate(
        folded, "id", "y", "fold", 2, train.FeatureSet(("x", "noise"), ()), train.forest(trees=5, depth=3)
    )
    assert cv.predictions.count() == 400
    assert all(r["auc"] > 0.8 for r in cv.metrics.collect())
    assert {r["feature"] for r in cv.importances.collect()} == {"x", "noise"}


def test_per_label_models(rows):
    pairs = rows.where("y = 1").select("id", F.lit("hi").alias("pt")).unionByName(
        rows.select("id", F.when(F.col("noise") == 1, "one").otherwise("rest").alias("pt"))
    )
    parts = splits.nested(rows, "id", 5)
    out = train.train_per_label(
        prep.bits_by_value(parts, "kind", nbits=16), pairs, "id", "pt", ["hi", "one"], "part",
        train.FeatureSet(("x", "noise"), (), "bits", 16), train.forest(trees=5, depth=4, min_leaf=1),
        tuning="stepped", refit=True, fill="zero",
    )
    assert {r["label"] for r in out.thresholds.collect()} == {"hi", "one"}
    aucs = {r["label"]: r["auc"] for r in evaluate.roc_auc(out.predictions, "y", "score", ["label"]).collect()}
    assert min(aucs.values()) > 0.8


def test_tune_and_refit(rows):
    parts = splits.nested(rows, "id", 5, ["y"])
    tuned = train.tune_and_refit(
        parts, "id", "y", "part", train.FeatureSet(("x", "noise"), ("kind",)),
        train.forest(trees=5, depth=4, min_leaf=1), fill="zero", encode="index",
    )
    assert 0.3 <= tuned.threshold <= 0.99
    assert evaluate.binary_metrics(tuned.predictions, "y", "pred").first()["f1"] > 0.7


def test_rescaled_scores(spark):
    df = spark.createDataFrame([(2.0,), (4.0,), (6.0,)], "raw double")
    assert [round(r["score"], 6) for r in train.rescaled_scores(df, "raw").collect()] == [0.0, 0.5, 1.0]
