"""Spearman's ranks are made once a column, and rows are never paired up."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casesignal.operators import stats


def plain(x, y):
    both = pd.DataFrame({"x": x, "y": y}).dropna()
    return len(both), both["x"].rank().corr(both["y"].rank())


@pytest.mark.parametrize("wide", [False, True])
def test_nulls_of_a_pair_and_wide_columns(spark, wide):
    rng = np.random.default_rng(5)
    n = 3000
    a, b = rng.integers(0, n if wide else 9, n).astype(float), rng.integers(0, 5, n).astype(float)
    x, y = np.round(a / n + rng.normal(size=n), 3), rng.integers(0, 7, n).astype(float)
    rows = [tuple(None if (i + j) % (11 + j) == 0 and j != 1 else float(v) for j, v in enumerate(r)) for i, r in enumerate(zip(a, b, x, y))]
    df = spark.createDataFrame(rows, "a double, b double, x double, y double")
    held = pd.DataFrame(rows, columns=list("abxy")).astype(float)
    got = {(r.prop, r.target): r for r in stats.spearman(df, ["a", "b"], ["x", "y"]).collect()}
    assert len(got) == 4
    for (p, t), r in got.items():
        size, rho = plain(held[p], held[t])
        assert r.n == size and r.rho == pytest.approx(rho, abs=1e-12)


def test_rows_are_not_stored_pair_by_pair(spark, monkeypatch):
    """What is written has a row for each value of a column, not for each pair of values."""
    written = []
    keep = stats.stored
    monkeypatch.setattr(stats, "stored", lambda df, label: written.append(keep(df, label)) or written[-1])
    df = spark.range(4000).select((F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 80).cast("double").alias("x"))
    assert stats.spearman(df, ["a"], ["x"]).count() == 1
    assert sum(w.count() for w in written) == 50 + 80
