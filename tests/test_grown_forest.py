"""Single forests grown on histograms: categories, unseen values, importances, queries."""

import pytest
from pyspark.sql import functions as F

from casesignal.catalog import modeling
from casesignal.operators import evaluate, splits
from casesignal.plans import train

FEATURES = train.FeatureSet(("x",), ("c",))


def rows(spark, n=600):
    df = spark.range(n).withColumn("c", F.expr("elt(id % 4 + 1, 'a', 'b', 'c', null)"))
    return df.select("id", (F.col("id") % 5).cast("double").alias("x"), "c", (F.coalesce(F.col("c"), F.lit("a")) == "b").cast("int").alias("y"))


def test_a_category_is_one_column_and_unseen_values_equal_none(spark):
    df = rows(spark)
    test = spark.createDataFrame([(1, 2.0, "a", 0), (2, 2.0, "b", 1), (3, None, "new", 0), (4, 3.0, None, 0)], df.schema)
    model, scored, names = train.grow_and_score(df, test, "id", "y", FEATURES, train.forest(trees=30, min_leaf=1))
    score = {r["id"]: r["score"] for r in scored.collect()}
    assert score[2] > 0.9 and max(score[1], score[3], score[4]) < 0.1
    shares = dict(model.importances())
    assert names[0] == "c_b" and set(names) == {"x", "c_a", "c_b", "c_c"} and sum(shares.values()) == pytest.approx(1)


def test_scores_of_distinct_codes_are_those_of_the_rows(spark):
    """Every row has its score, though equal codes go through the trees once."""
    df = rows(spark).withColumn("y", F.when(F.col("id") % 7 == 0, 1 - F.col("y")).otherwise(F.col("y")))
    model, scored, _ = train.grow_and_score(df, df, "id", "y", FEATURES, train.forest(trees=5, min_leaf=2))
    got = {r["id"]: r["score"] for r in scored.collect()}
    binning, table = train.bagged.encode_rows(df, ["id"], ["x"], None, 0, None, 255, ["c"], {"c": "a"})
    assert binning.values == model.binning.values
    plain = {r["id"]: r["scores"][0] for r in model.score(table, ["id"]).collect()}
    assert got == pytest.approx(plain) and len(got) == 600


def test_tuning_with_grown_forests(spark, monkeypatch):
    monkeypatch.setattr(train, "fit_and_score", None)
    parts = splits.nested(rows(spark), "id", 5, ["y"])
    tuned = train.tune_and_refit(parts, "id", "y", "part", FEATURES, train.forest(trees=9, min_leaf=1), grown=True, fill="zero")
    assert evaluate.binary_metrics(tuned.predictions, "y", "pred").first()["f1"] > 0.9


def test_queries_of_a_single_forest_grow_it_on_histograms(spark, monkeypatch):
    sized = train.forest
    monkeypatch.setattr(train, "forest", lambda trees=400, **kw: sized(trees=3, **kw))
    monkeypatch.setattr(train.RandomForestClassifier, "fit", None)
    assert modeling.forest_report(spark, "/root/testdata/sf0.001").count() == 5
    names = [r["feature"] for r in modeling.forest_top_importances(spark, "/root/testdata/sf0.001").collect()]
    assert {"age", "sex_F", "sex_M"} <= set(names)
    assert modeling.forest_multi_vs_single(spark, "/root/testdata/sf0.001").count() == 1
