"""Metrics, thresholds and order statistics against plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from casesignal.operators import evaluate, order, prep, stats


def scored(n=300, seed=1, ties=20):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.3)
        rows.append((i, "ab"[i % 2], y, round((rnd.random() + 0.4 * y) * ties) / ties / 1.5))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, label string, y int, score double")


def auc(rows):
    pos = [s for *_, y, s in rows if y]
    neg = [s for *_, y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def curve(rows):
    """(threshold, tp, fp) by rising threshold."""
    return [
        (t, sum(y for *_, y, s in rows if s >= t), sum(1 - y for *_, y, s in rows if s >= t))
        for t in sorted({r[-1] for r in rows})
    ]


def test_areas(spark):
    rows = scored()
    got = evaluate.auc_and_ap(frame(spark, rows), "y", "score").first()
    assert math.isclose(got["auc"], auc(rows))
    p = sum(r[2] for r in rows)
    down, ap, before = curve(rows)[::-1], 0.0, 0
    for _, tp, fp in down:
        ap += (tp - before) / p * tp / (tp + fp)
        before = tp
    assert math.isclose(got["ap"], ap)


@pytest.mark.parametrize("bucket_rows", [20_000, 100, 7])
def test_totals_at_any_number_of_buckets(spark, bucket_rows):
    """Null groups, null and NaN values among them: null first, NaN last."""
    nan = float("nan")
    table = {(g, s): (i * 7) % 5 for g in ("a", "b", None) for i, s in enumerate([None, nan, *[x / 8 for x in range(-60, 90)]])}
    df = spark.createDataFrame([(g, s, n) for (g, s), n in table.items()], "label string, score double, n long")
    got = order.running_totals(df, "score", ["n"], ["label"], "prev", bucket_rows=bucket_rows).collect()
    place = lambda s: (-1e9 if s is None else 1e9 if math.isnan(s) else s)
    assert len(got) == len(table)
    for r in got:
        own = {place(s): n for (g, s), n in table.items() if g == r.label}
        below = [x for x in own if x < place(r.score)]
        assert r.n_total == sum(own.values()) and r.n_before == sum(own[x] for x in below)
        assert (r.prev if r.prev is not None else -1e9) == max(below, default=-1e9)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_totals_over_batches_and_nan_groups(spark, batch):
    """Groups of several columns that go on over batches and ranges; NaN is one group."""
    nan = float("nan")
    groups = [("a", nan), ("a", 1.0), (None, nan), ("b", None)]
    rows = [(g, h, v, (v * 5) % 3, v / 4) for g, h in groups for v in range(23)]
    df = spark.createDataFrame(rows, "g string, h double, v int, n int, x double").repartition(3)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = order.running_totals(df, "v", ["n", "x"], ["g", "h"], "prev", bucket_rows=20).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(got) == len(rows)
    for r in got:
        assert r.n_before == sum((v * 5) % 3 for v in range(r.v)) and r.n_total == sum((v * 5) % 3 for v in range(23))
        assert r.x_before == sum(v / 4 for v in range(r.v)) and r.prev == (r.v - 1 if r.v else None)
    empty = order.running_totals(df.limit(0), "v", ["n"], ["g"], "prev")
    assert empty.collect() == [] and empty.columns == [*df.columns, "n_before", "n_total", "prev"]


def test_rows_without_a_threshold_take_the_default(spark):
    df = spark.createDataFrame([("a", 0.4), ("a", 0.9), ("b", 0.4), ("b", 0.6), (None, 0.45)], "label string, score double")
    table = spark.createDataFrame([("a", 0.8), (None, 0.4)], "label string, threshold double")
    got = [tuple(r) for r in evaluate.apply_threshold(df, "score", table, ["label"]).collect()]
    assert sorted(got, key=str) == sorted([("a", 0.4, 0), ("a", 0.9, 1), ("b", 0.4, 0), ("b", 0.6, 1), (None, 0.45, 1)], key=str)


def test_profile_of_numbers_beyond_a_long(spark):
    df = spark.createDataFrame([(float("nan"), 1e30, 1.0, None), (0.0, 1.0, 0.0, None)], "a double, b double, c double, d double")
    got = {r.column: (r.non_null, r.varied, r.binary) for r in prep.profile(df, df.columns).collect()}
    assert got == {"a": (2, True, False), "b": (2, True, False), "c": (2, True, True), "d": (0, False, False)}


def test_thresholds(spark):
    rows = scored()
    points = curve(rows)
    p = sum(r[2] for r in rows)
    f1 = [2 * tp / (p + tp + fp) for _, tp, fp in points]
    best = int(np.argmax(f1))
    df = frame(spark, rows)
    assert evaluate.best_threshold(df, "y", "score").first()["threshold"] == points[best][0]
    want = 0.5 if best == 0 else min(max(points[best - 1][0], 0.3), 0.99)
    assert evaluate.stepped_threshold(df, "y", "score", low=0.3).first()["threshold"] == want


def test_threshold_edges(spark):
    all_equal = [(0, "a", 1, 0.4), (1, "a", 0, 0.4)]
    lowest = [(2, "b", 1, 0.1), (3, "b", 1, 0.2), (4, "b", 0, 0.05)]
    one_class = [(5, "c", 1, 0.2), (6, "c", 1, 0.9)]
    df = frame(spark, all_equal + lowest + one_class)
    got = {r["label"]: r["threshold"] for r in evaluate.stepped_threshold(df, "y", "score", ["label"]).collect()}
    assert got == {"a": 0.5, "b": 0.05, "c": 0.5}
    aucs = {r["label"]: r["auc"] for r in evaluate.roc_auc(df, "y", "score", ["label"]).collect()}
    assert aucs == {"a": 0.5, "b": 1.0, "c": None}
    mean = evaluate.mean_auc(df, "y", "score", "label").first()
    assert (mean["mean_auc"], mean["n_labels"]) == (0.75, 2)
    assert evaluate.micro_macro_auc(df, "y", "score", "label").first()["macro_auc"] is None


def test_grid(spark):
    rows = scored()

    def f1(t):
        tp = sum(y for *_, y, s in rows if s >= t)
        fp = sum(1 - y for *_, y, s in rows if s >= t)
        return 2 * tp / (sum(r[2] for r in rows) + tp + fp)

    want = evaluate.THRESHOLD_GRID[int(np.argmax([f1(t) for t in evaluate.THRESHOLD_GRID]))]
    assert evaluate.grid_threshold(frame(spark, rows), "y", "score").first()["threshold"] == want


def test_report_of_a_known_matrix(spark):
    cells = spark.createDataFrame([(1222, 148395, 564, 242949)], "tn long, fp long, fn long, tp long")
    rows = {r["class"]: r for r in evaluate.classification_report(cells).collect()}
    shown = lambda r: tuple(round(r[c], 3) for c in ("precision", "recall", "f1"))
    assert shown(rows["0"]) == (0.684, 0.008, 0.016) and rows["0"]["support"] == 149617
    assert shown(rows["1"]) == (0.621, 0.998, 0.765) and rows["1"]["support"] == 243513
    assert round(rows["accuracy"]["f1"], 3) == 0.621
    assert shown(rows["macro avg"]) == (0.653, 0.503, 0.391)
    assert shown(rows["weighted avg"]) == (0.645, 0.621, 0.480)


def test_metrics_without_predictions(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    assert tuple(evaluate.binary_metrics(df, "y", "pred").first()) == (0.0, 0.0, 0.0)
    assert tuple(evaluate.confusion(df, "y", "pred").first()) == (2, 0, 0, 0)


def test_median(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, rnd.randrange(9), rnd.random()]), float(i)) for i in range(101)]
    df = spark.createDataFrame([(None if a is None else float(a), b) for a, b in rows], "a double, b double")
    got = {r["column"]: r["median"] for r in order.exact_median(df, ["a", "b"]).collect()}
    assert got["a"] == statistics.median([a for a, _ in rows if a is not None])
    assert got["b"] == 50.0


def rank(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def test_spearman(spark):
    rnd = random.Random(2)
    rows = [(float(rnd.randrange(8)), float(rnd.randrange(8)), None if i % 9 else 1.0, 3.0) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y double, few double, same double")
    got = {(r["prop"], r["target"]): r for r in stats.with_p_value(stats.spearman(df, ["x", "same"], ["y"])).collect()}
    want = np.corrcoef(rank([r[0] for r in rows]), rank([r[1] for r in rows]))[0, 1]
    assert math.isclose(got["x", "y"]["rho"], want) and got["x", "y"]["n"] == 40
    assert got["same", "y"]["rho"] is None and got["same", "y"]["p_value"] is None
    three = df.limit(3)
    assert stats.spearman(three, ["x"], ["y"]).count() == 0


@pytest.mark.parametrize(
    "rho, n, p",
    # t = 1 with 1, 2 and 3 degrees of freedom has a closed form.
    [
        (math.sqrt(1 / 2), 3, 0.5),
        (math.sqrt(1 / 3), 4, 1 - 1 / math.sqrt(3)),
        (math.sqrt(1 / 4), 5, 1 - 2 / math.pi * (math.sqrt(3) / 4 + math.pi / 6)),
    ],
)
def test_p_value(rho, n, p):
    assert math.isclose(stats.two_sided_p(rho, n), p, rel_tol=1e-9)
    assert stats.two_sided_p(0.0, n) == 1.0 and stats.two_sided_p(1.0, n) == 0.0
