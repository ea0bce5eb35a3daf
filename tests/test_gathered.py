"""Trees grown within a task on all distinct codes, against those grown by jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casesignal.catalog import modeling
from casesignal.operators import binned
from casesignal.plans import bagged, boost, gathered, train
from tests.test_bagged import table as bit_table
from tests.test_boost import table

SETTINGS = boost.Settings(rounds=6, depth=4, rate=0.3, rows=0.7, columns=0.7, least=0.5)


def same_trees(one, two):
    for a, b in zip(one, two, strict=True):
        assert a.feature.shape == b.feature.shape and a.feature.shape[1] > 3
        assert all((getattr(a, n) == getattr(b, n)).all() for n in ("feature", "code", "left"))
        assert all(np.allclose(getattr(a, n), getattr(b, n)) for n in ("value", "gain", "cover"))


def test_a_task_grows_the_trees_of_the_jobs(spark, monkeypatch):
    """Models of labels and of folds, on features that share a column and on those that do not; no level runs a job."""
    df = table(spark, 400, 8)

    def fits():
        return [
            boost.fit_table(df, "id", ["a", "b"], ["x", "z"], ["kind"], SETTINGS)[0].trees,
            boost.fit_table(df, "id", ["a"], ["x", "z"], ["kind"], SETTINGS, fold="fold", folds=3)[0].trees,
        ]

    monkeypatch.setattr(gathered, "MOST", 0)
    by_jobs = fits()
    monkeypatch.undo()
    monkeypatch.setattr(boost, "to_blocks", None)
    for joint in (1, 40, 1 << 12):
        monkeypatch.setattr(boost, "JOINT", joint)
        for one, two in zip(fits(), by_jobs, strict=True):
            same_trees(one, two)


def test_joint_codes_keep_every_feature():
    rng = np.random.default_rng(3)
    sizes = np.array([5, 2, 300, 7, 3])
    codes = np.stack([rng.integers(0, n, 500) for n in sizes], axis=1).astype(np.uint16)
    codes[:, 4] = codes[:, 3] % 3
    columns = gathered.joined(codes, sizes, 64)
    assert len(columns.joint) < 5
    for f in range(5):
        assert (columns.code[f][columns.joint[columns.of[f]]] == codes[:, f]).all()


def test_large_groups_are_drawn_by_number(spark):
    """2,000 rows of two codes are counts by fold and class; a tree draws its share of them."""
    df = spark.range(2000).select("id", (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 5 == 0).cast("int").alias("a"), (F.col("id") % 4).cast("int").alias("fold"))
    binning = binned.fit_binning(df, ["x"])
    groups = gathered.gather(binned.encode(df, binning, ["id", "a", "fold"]), binning, ["a"], "id", "fold")
    assert len(groups.codes) == 2 and len(groups.key) == 0
    rows = groups.learned(0, 1)
    assert rows.counts.tolist() == [[200, 100], [800, 400]]
    settings = boost.Settings(rows=0.9)
    drawn = np.array([boost.drawn_counts(rows, settings, 0, t) for t in range(200)])
    assert (drawn <= rows.counts).all() and drawn.mean(axis=0) == pytest.approx(0.9 * rows.counts, rel=0.02)
    assert (drawn[3] == boost.drawn_counts(rows, settings, 0, 3)).all() and (drawn[3] != drawn[4]).any()
    assert (boost.drawn_counts(rows, boost.Settings(rows=1.0), 0, 0) == rows.counts).all()


def test_scores_of_distinct_codes_are_those_of_the_rows(spark):
    df = table(spark, 300, 2)
    df = df.unionByName(df.withColumn("id", F.col("id") + 1000))
    fitted, encoded = boost.fit_table(df, "id", ["a"], ["x", "z"], ["kind"], SETTINGS, fold="fold", folds=3)
    want = {r["id"]: r["score"] for r in fitted.score(encoded, ["id", "fold"], model="fold").collect()}
    got = {r["id"]: r["score"] for r in fitted.score_once(encoded, ["id", "fold"], "fold").collect()}
    assert len(got) == 600 and got == pytest.approx(want)


@pytest.mark.parametrize("every", [0, 4])
def test_a_task_grows_the_forests_of_the_jobs(spark, monkeypatch, every):
    """Whether all features of a node are looked at or the drawn ones alone; with categories and missing values."""
    df = bit_table(spark, 300, 4).withColumn("c", F.expr("elt(id % 4 + 1, 'p', 'q', 'r', null)"))
    binning, encoded = bagged.encode_rows(df, ["id", "a", "b"], ["x", "z"], "bits", 6, None, 255, ["c"], {})
    settings = bagged.Settings(trees=4, least=2)
    by_task = []
    for most in (0, 1 << 27):
        monkeypatch.setattr(gathered, "MOST", most)
        monkeypatch.setattr(bagged, "ALL", every)
        monkeypatch.setattr(bagged, "BATCH", 8 if most == 0 else 3)
        forests = bagged.fit_rows(encoded, binning, "id", ["a", "b"], settings)
        by_task.append([
            [(t.feature[m, i], t.code[m, i], t.left[m, i], t.value[m, i], t.gain[m, i]) for i in np.flatnonzero(t.cover[m])]
            for t, label in forests.batches for m in range(len(label))
        ])
    assert len(by_task[0]) == 8 and min(map(len, by_task[0])) > 9
    for one, two in zip(*by_task, strict=True):
        assert np.allclose(one, two)


def test_scores_made_where_the_trees_are(spark, monkeypatch):
    df = bit_table(spark, 300, 6)
    df = df.unionByName(df.withColumn("id", F.col("id") + 1000))
    binning, encoded = bagged.encode_rows(df, ["id", "a", "b"], ["x", "z"], "bits", 6)
    learn, other = encoded.where("id % 3 > 0"), encoded.where("id % 3 = 0")
    settings = bagged.Settings(trees=5)
    want = {r["id"]: r["scores"] for r in bagged.fit_rows(learn, binning, "id", ["a", "b"], settings).score(other, ["id"]).collect()}
    monkeypatch.setattr(bagged, "TREES", 2)
    got = {r["id"]: r["scores"] for r in bagged.scored_by_rows(learn, other, ["id"], binning, "id", ["a", "b"], settings).collect()}
    assert set(got) == set(want) and len(got) == 200
    assert all(got[i] == pytest.approx(want[i]) for i in want)


class Found(Exception):
    pass


def test_forests_of_labels_have_the_published_trees(spark, monkeypatch):
    def caught(*args, **kwargs):
        raise Found(args)

    monkeypatch.setattr(train, "forest_per_label", caught)
    with pytest.raises(Found) as found:
        modeling.forest_per_label(spark, "/root/testdata/sf0.001")
    (settings,) = [a for a in found.value.args[0] if isinstance(a, bagged.Settings)]
    assert (settings.trees, settings.least, settings.depth) == (500, 1, None)


@pytest.mark.parametrize(("name", "fit", "rounds"), [
    ("boosted_cv_metrics", "cross_validate_boosted", 800), ("boosted_oof_report", "cross_validate_boosted", 800),
    ("boosted_importances", "cross_validate_boosted", 800), ("boosted_per_label", "boosted_per_label", 1200),
])
def test_boosted_queries_take_the_published_rounds(spark, monkeypatch, name, fit, rounds):
    def caught(*args, **kwargs):
        raise Found(args)

    modeling._cross_validated_once.cache_clear()
    monkeypatch.setattr(train, fit, caught)
    with pytest.raises(Found) as found:
        getattr(modeling, name)(spark, "/root/testdata/sf0.001")
    (settings,) = [a for a in found.value.args[0] if isinstance(a, boost.Settings)]
    assert settings.rounds == rounds
