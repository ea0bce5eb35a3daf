"""Forests on histograms against trees grown row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casesignal.operators import evaluate, splits
from casesignal.plans import bagged, train

SCHEMA = "id long, x double, z double, bits array<int>, a int, b int"


def table(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, z = float(rng.integers(0, 9)), float(np.round(rng.normal(), 1))
        bits = sorted({int(v) for v in rng.integers(0, 6, rng.integers(0, 4))})
        odds = x / 4 - 1 + (2 in bits) - z
        a, b = (int(rng.random() < 1 / (1 + np.exp(-v))) for v in (odds, 1.5 - odds))
        rows.append((i, None if i % 9 == 0 else x, float("nan") if i % 13 == 0 else z, bits or None, a, b))
    return spark.createDataFrame(rows, SCHEMA)


def plain_tree(codes, y, keys, binning, usable, settings, model, tree):
    """Rows repeated by their bag, every split counted over them, depth first."""
    drawn = bagged.bag(np.array(keys, dtype=np.int64), settings.seed, tree)
    k = min(len(usable), max(1, int(math.sqrt(len(binning.names)))))
    rows = [i for i in range(len(y)) for _ in range(int(drawn[i]))]
    pos = sum(y[i] for i in rows)
    wp, wn = (len(rows) / (2 * c) if c else 0.0 for c in (pos, len(rows) - pos))

    def gini(own):
        p = wp * sum(y[i] for i in own)
        n = wn * sum(1 - y[i] for i in own)
        return 2 * p * n / (p + n) if p + n else 0.0

    def level_order():
        """Nodes are numbered breadth first, as the draws of features need."""
        out, waiting, attempt, used = {}, [(0, rows, 0)], {0: 0}, 1
        while waiting:
            later, children = [], {}
            for node, own, depth in waiting:
                positives = sum(y[i] for i in own)
                share = wp * positives / (wp * positives + wn * (len(own) - positives)) if own else 0.0
                out.setdefault(node, [share, None])
                if positives in (0, len(own)) or len(own) < 2 * settings.least or depth == settings.depth:
                    continue
                feats = bagged.node_features(usable, settings.seed, np.array([model]), np.array([node]), np.array([attempt[node]]), k)[0]
                best = None
                for f in feats:
                    for code in range(1, binning.sizes[f]):
                        left, right = [i for i in own if codes[i][f] <= code], [i for i in own if codes[i][f] > code]
                        if min(len(left), len(right)) < settings.least:
                            continue
                        gain = gini(own) - gini(left) - gini(right)
                        if gain > 1e-9 and (best is None or gain > best[0] + abs(best[0]) * 1e-8):
                            best = gain, int(f), code, left, right
                if best is None:
                    attempt[node] += 1
                    if attempt[node] * k < len(usable):
                        later.append((node, own, depth))
                    continue
                children[node] = best, depth
            for node in sorted(children):
                best, depth = children[node]
                out[node][1] = (*best[:3], used)
                later += [(used + side, best[3 + side], depth + 1) for side in (0, 1)]
                attempt |= {used: 0, used + 1: 0}
                used += 2
            waiting = sorted(later, key=lambda q: q[0])
        return out

    return level_order()


@pytest.mark.parametrize("settings", [bagged.Settings(trees=3, seed=5), bagged.Settings(trees=2, least=3, depth=4, seed=9)])
def test_equal_plain_trees(spark, settings, monkeypatch):
    monkeypatch.setattr("casesignal.plans.boost.TASK_ROWS", 40)
    monkeypatch.setattr(bagged, "BATCH", 4)
    monkeypatch.setattr(bagged, "CELLS", 60)
    df = table(spark)
    binning, encoded = bagged.encode_rows(df, ["id", "a", "b"], ["x", "z"], "bits", 6)
    forests = bagged.fit_rows(encoded, binning, "id", ["a", "b"], settings)
    rows = sorted(df.withColumn("key", F.xxhash64("id")).collect(), key=lambda r: r["id"])
    codes = []
    for r in rows:
        numbers = [0.0 if v is None or v != v else v for v in (r["x"], r["z"])]
        codes.append([1 + sum(c < v for c in cuts) for v, cuts in zip(numbers, binning.cuts)] + [2 if i in (r["bits"] or []) else 1 for i in range(6)])
    usable = np.array([f for f in range(8) if len({c[f] for c in codes}) > 1])
    keys, number, total = [r["key"] for r in rows], 0, np.zeros((len(rows), 2))
    for trees, label in forests.batches:
        for m in range(len(label)):
            y = [r["ab"[label[m]]] for r in rows]
            plain = plain_tree(codes, y, keys, binning, usable, settings, number, number // 2)
            for node, (share, split) in plain.items():
                assert trees.value[m, node] == pytest.approx(share, abs=1e-12)
                got = (trees.feature[m, node], trees.code[m, node], trees.left[m, node]) if trees.feature[m, node] >= 0 else None
                assert got == (split[1:] if split else None)
                if split:
                    assert trees.gain[m, node] == pytest.approx(split[0], abs=1e-9)
            assert len(plain) > 5
            for i, c in enumerate(codes):
                node = 0
                while plain[node][1]:
                    _, f, code, left = plain[node][1]
                    node = left + (c[f] > code)
                total[i, label[m]] += plain[node][0]
            number += 1
    scores = {r["id"]: r["scores"] for r in forests.score(encoded, ["id"]).collect()}
    assert number == 2 * settings.trees
    for i, r in enumerate(rows):
        assert scores[r["id"]] == pytest.approx((total[i] / settings.trees).tolist(), abs=1e-12)


def test_bags_are_poisson_and_classes_balance():
    key = np.arange(200_000, dtype=np.int64)
    n = bagged.bag(key, 1, 7)
    assert n.mean() == pytest.approx(1, abs=0.01) and n.var() == pytest.approx(1, abs=0.02) and (n == 0).mean() == pytest.approx(math.exp(-1), abs=0.005)
    assert (n != bagged.bag(key, 1, 8)).any() and (n == bagged.bag(key, 1, 7)).all()
    wp, wn = bagged.bag_weights(np.array([10, 0]), np.array([30, 5]))
    assert wp.tolist() == [2.0, 0.0] and wn.tolist() == [40 / 60, 0.5]


def test_a_walk_over_features_meets_each_once():
    usable = np.array([3, 5, 8, 9, 11, 20])
    for node in range(40):
        seen = [bagged.node_features(usable, 1, np.array([2]), np.array([node]), np.array([i]), 2)[0].tolist() for i in range(3)]
        assert sorted(sum(seen, [])) == usable.tolist()


def test_identical_rows_of_both_classes_end(spark):
    """Rows that no feature tells apart stay in one leaf of their balanced share."""
    df = spark.range(60).select("id", F.lit(1.0).alias("x"), (F.col("id") % 3 == 0).cast("int").alias("a"))
    binning, encoded = bagged.encode_rows(df, ["id", "a"], ["x"], None, 0)
    forests = bagged.fit_rows(encoded, binning, "id", ["a"], bagged.Settings(trees=4))
    assert all(t.feature.max() == -1 for t, _ in forests.batches)
    none = bagged.fit_rows(encoded.where("id < 0"), binning, "id", ["a"], bagged.Settings(trees=2))
    assert none.score(encoded, ["id"]).count() == 60


def test_forest_per_label(spark):
    df = splits.nested(table(spark, 700, 3), "id", 5)
    pairs = df.where("a = 1").select("id", F.lit("A").alias("pt")).unionByName(df.where("b = 1").select("id", F.lit("B").alias("pt")))
    thresholds, predictions = train.forest_per_label(df, pairs, "id", "pt", ["A", "B"], "part", train.FeatureSet(("x", "z"), (), "bits", 6), bagged.Settings(trees=25))
    assert {r["label"] for r in thresholds.collect()} == {"A", "B"}
    aucs = {r["label"]: r["auc"] for r in evaluate.roc_auc(predictions, "y", "score", ["label"]).collect()}
    assert min(aucs.values()) > 0.65
