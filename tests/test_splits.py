"""Splits: sizes per stratum, coverage, reproducibility."""

import math
from collections import Counter

from pyspark.sql import functions as F

from casesignal.operators import splits


def strata(spark, n=503):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 7 == 0, "rare").otherwise("common").alias("s")
    )


def test_stratified_holdout_sizes(spark):
    rows = splits.stratified_holdout(strata(spark), "id", ["s"], 42).collect()
    assert len(rows) == 503
    total, test = Counter(r["s"] for r in rows), Counter(r["s"] for r in rows if r["is_test"])
    assert all(test[k] == math.ceil(0.2 * n) for k, n in total.items())


def test_folds_cover_each_id_once(spark):
    df = strata(spark)
    rows = splits.stratified_folds(df, "id", ["s"], 1).collect()
    assert sorted(r["id"] for r in rows) == list(range(503))
    for s in ("common", "rare", None):
        sizes = Counter(r["fold"] for r in rows if r["s"] == s)
        assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 1
    again = splits.stratified_folds(df.repartition(7), "id", ["s"], 1).collect()
    assert {r["id"]: r["fold"] for r in rows} == {r["id"]: r["fold"] for r in again}


def test_nested_parts(spark):
    rows = splits.nested(strata(spark), "id", 3).collect()
    parts = Counter(r["part"] for r in rows)
    assert sorted(r["id"] for r in rows) == list(range(503))
    assert parts["train"] > parts["test"] > 0 and parts["val"] > 0


def test_plain_holdout_has_no_shuffle(spark):
    plan = splits.holdout(strata(spark), "id", 42)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
