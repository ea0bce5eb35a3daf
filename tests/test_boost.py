"""Boosted trees on histograms against plain trees, their table and their jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casesignal.operators import binned, evaluate, splits, trees
from casesignal.plans import boost, train

SCHEMA = "id long, x double, z double, kind string, flat double, a int, b int, fold int"


def table(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, z = float(rng.integers(0, 12)), float(np.round(rng.normal(), 2))
        kind = ["p", "q", "r", None][rng.integers(0, 4)]
        odds = x / 6 - 1 + (kind == "q") + z / 2
        a, b = (int(rng.random() < 1 / (1 + np.exp(-v))) for v in (odds, -odds))
        rows.append((i, None if i % 9 == 0 else x, float("nan") if i % 13 == 0 else z, kind, 3.0, a, b, i % 3))
    return spark.createDataFrame(rows, SCHEMA)


def plain_codes(rows, binning):
    out = []
    for r in rows:
        own = []
        for name, cuts in zip(binning.numeric, binning.cuts):
            v = r[name]
            own.append(0 if v is None or v != v else 1 + sum(c < v for c in cuts))
        for name, values in zip(binning.categorical, binning.values):
            own.append(1 + values.index(r[name]) if r[name] in values else 0)
        out.append(own)
    return out


def plain_fill(codes, binning):
    out = []
    for j in range(len(binning.names)):
        known = sorted(c[j] for c in codes if c[j])
        if not known:
            out.append(1)
        elif binning.ordered[j]:
            out.append(known[(len(known) - 1) // 2])
        else:
            out.append(min(set(known), key=lambda v: (-known.count(v), v)))
    return out


def plain_boost(codes, y, use, fill, binning, settings, model, keys):
    """Rows walked one by one, sums added one by one; recursion instead of levels."""
    weight = sum(1 - v for v, u in zip(y, use) if u) / max(1, sum(v for v, u in zip(y, use) if u))
    margins, forest = [0.0] * len(codes), []
    full = [[f if c == 0 else c for c, f in zip(row, fill)] for row in codes]

    def right(row, f, code):
        return row[f] > code if binning.ordered[f] else row[f] == code

    def grow(rows, g, h, depth, features):
        gt, ht = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = None
        if depth:
            for f in features:
                for code in range(1, binning.sizes[f] - (1 if binning.ordered[f] else 0)):
                    gr, hr = (sum(v[i] for i in rows if right(full[i], f, code)) for v in (g, h))
                    gl, hl = gt - gr, ht - hr
                    if min(hl, hr) < settings.least or min(hl, hr) <= 1e-12:
                        continue
                    gain = gl**2 / (hl + settings.l2) + gr**2 / (hr + settings.l2) - gt**2 / (ht + settings.l2)
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-7)):
                        best = gain, f, code
        leaf = -settings.rate * gt / (ht + settings.l2)
        if best is None:
            return (leaf,)
        gain, f, code = best
        sides = ([i for i in rows if not right(full[i], f, code)], [i for i in rows if right(full[i], f, code)])
        return (leaf, gain, f, code, *[grow(s, g, h, depth - 1, features) for s in sides])

    def value(tree, row):
        while len(tree) > 1:
            tree = tree[5] if right(row, tree[2], tree[3]) else tree[4]
        return tree[0]

    for t in range(settings.rounds):
        drawn = boost.drawn_rows(np.array(keys, dtype=np.int64), settings, model, t)
        p = [1 / (1 + np.exp(-m)) for m in margins]
        w = [weight if v else 1.0 for v in y]
        g, h = [a * (b - c) for a, b, c in zip(w, p, y)], [a * b * (1 - b) for a, b in zip(w, p)]
        rows = [i for i in range(len(codes)) if use[i] and drawn[i]]
        features = boost.drawn_columns(len(binning.names), settings, model, t).tolist()
        forest.append(grow(rows, g, h, settings.depth, features))
        margins = [m + value(forest[-1], row) for m, row in zip(margins, full)]
    return forest, margins


def same(tree, node, plain):
    """The arrays of one model's tree say what the plain tree says."""
    m, i = node
    assert tree.value[m, i] == pytest.approx(plain[0], abs=1e-9)
    if len(plain) == 1:
        assert tree.feature[m, i] == -1
        return 1
    assert (tree.feature[m, i], tree.code[m, i]) == plain[2:4] and tree.gain[m, i] == pytest.approx(plain[1], rel=1e-6)
    return 1 + sum(same(tree, (m, tree.left[m, i] + k), plain[4 + k]) for k in (0, 1))


@pytest.mark.parametrize("settings", [
    boost.Settings(rounds=4, depth=3, rate=0.3, least=1.03, rows=1.0, columns=1.0),
    boost.Settings(rounds=10, depth=2, rate=0.5, least=0.0, l2=0.5, rows=0.7, columns=0.6, seed=3),
])
def test_folds_equal_plain_trees(spark, settings, monkeypatch):
    """Three folds' models from one set of jobs, over several blocks and checkpoints."""
    monkeypatch.setattr(boost, "TASK_ROWS", 30)
    monkeypatch.setattr(boost, "CHECKPOINT", 2)
    df = table(spark)
    fitted, encoded = boost.fit_table(df, "id", ["a"], ["x", "z", "flat"], ["kind"], settings, fold="fold", folds=3)
    rows = sorted(df.withColumn("key", F.xxhash64("id")).collect(), key=lambda r: r["id"])
    codes, y = plain_codes(rows, fitted.binning), [r["a"] for r in rows]
    scores = {r["id"]: r["score"] for r in fitted.score(encoded, ["id", "fold"], model="fold").collect()}
    for k in range(3):
        use = [r["fold"] != k for r in rows]
        fill = plain_fill([c for c, u in zip(codes, use) if u], fitted.binning)
        assert fitted.models.fill[k].tolist() == fill
        forest, margins = plain_boost(codes, y, use, fill, fitted.binning, settings, k, [r["key"] for r in rows])
        assert sum(same(tree, (k, 0), plain) for tree, plain in zip(fitted.trees, forest, strict=True)) > settings.rounds
        for r, margin in zip(rows, margins):
            if r["fold"] == k:
                assert scores[r["id"]] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_labels_equal_single_fits(spark):
    """Models of two labels in the same jobs are those fitted one at a time."""
    settings = boost.Settings(rounds=3, depth=3, rows=1.0, columns=1.0)
    df = table(spark, 300, 4)
    both, _ = boost.fit_table(df, "id", ["a", "b"], ["x", "z"], ["kind"], settings)
    for m, name in enumerate(("a", "b")):
        one, _ = boost.fit_table(df, "id", [name], ["x", "z"], ["kind"], settings)
        for t, u in zip(both.trees, one.trees):
            n = u.feature.shape[1]
            assert n > 1 and (t.feature[m, :n] == u.feature[0]).all() and np.allclose(t.value[m, :n], u.value[0])


def test_sql_walks_the_node_table(spark):
    """Scores from the exported nodes and the raw features, by joins alone, are the engine's."""
    settings = boost.Settings(rounds=5, depth=4, rate=0.4, least=0.5)
    df = table(spark, 250, 7)
    fitted, encoded = boost.fit_table(df, "id", ["a"], ["x", "z"], ["kind"], settings)
    want = {r["id"]: r["scores"][0] for r in fitted.score(encoded, ["id"]).collect()}
    fitted.nodes(spark).createOrReplaceTempView("nodes")
    df.createOrReplaceTempView("cases")
    step = """SELECT c.id, n.tree, CASE WHEN n.feature IS NULL THEN n.node WHEN
        coalesce(CASE n.feature WHEN 'kind' THEN kind = n.category WHEN 'x' THEN nanvl(x, NULL) > n.threshold ELSE nanvl(z, NULL) > n.threshold END, n.missing_right)
        THEN n.right_child ELSE n.left_child END AS node FROM {} c JOIN nodes n ON c.tree = n.tree AND c.node = n.node JOIN cases USING (id)"""
    at = "(SELECT id, tree, 0 AS node FROM cases CROSS JOIN (SELECT DISTINCT tree FROM nodes))"
    for _ in range(settings.depth):
        at = f"({step.format(at)})"
    got = spark.sql(f"SELECT id, sum(value) AS margin FROM {at} JOIN nodes USING (tree, node) GROUP BY id").collect()
    assert len(got) == 250
    for r in got:
        assert 1 / (1 + np.exp(-r["margin"])) == pytest.approx(want[r["id"]], abs=1e-9)


def test_cross_validation(spark):
    df = splits.stratified_folds(table(spark, 600, 2).drop("fold"), "id", ["a"], 1, folds=3)
    cv = train.cross_validate_boosted(df, "id", "a", "fold", 3, train.FeatureSet(("x", "z"), ("kind",)), boost.Settings(rounds=12, depth=3, rate=0.2))
    assert cv.predictions.count() == 600 and cv.metrics.count() == 3
    assert evaluate.roc_auc(cv.predictions, "a", "score").first()["auc"] > 0.65
    gains = {r["feature"]: r["importance"] for r in cv.importances.collect()}
    assert set(gains) == {"x", "z", "kind_p", "kind_q", "kind_r"} and gains["x"] > 0
    used = cv.nodes.where("feature = 'x'").groupBy("model").agg(F.avg("gain").alias("g")).collect()
    assert gains["x"] == pytest.approx(sum(r["g"] for r in used) / 3)


def test_per_label(spark):
    df = splits.nested(table(spark, 600, 5).drop("fold"), "id", 5)
    pairs = df.where("a = 1").select("id", F.lit("A").alias("pt")).unionByName(df.where("b = 1").select("id", F.lit("B").alias("pt")))
    out = train.boosted_per_label(df, pairs, "id", "pt", ["A", "B"], "part", train.FeatureSet(("x", "z"), ("kind",)), boost.Settings(rounds=10, depth=3, rate=0.2))
    assert {r["label"] for r in out.thresholds.collect()} == {"A", "B"}
    aucs = {r["label"]: r["auc"] for r in evaluate.roc_auc(out.predictions, "y", "score", ["label"]).collect()}
    assert min(aucs.values()) > 0.6 and out.nodes.select("model").distinct().count() == 2


def test_wide_category_is_one_column(spark):
    """20,000 values: no column for each, and a split still finds one of them."""
    df = spark.range(40_000).select("id", (F.col("id") % 20_000).cast("string").alias("code"), (F.col("id") % 20_000 == 7).cast("int").alias("y"))
    fitted, encoded = boost.fit_table(df, "id", ["y"], [], ["code"], boost.Settings(rounds=1, depth=1, least=0.0, rows=1.0, columns=1.0))
    top = fitted.nodes(spark).where("node = 0").first()
    assert (top["feature"], top["category"]) == ("code", "7")
    high = {r["id"] for r in fitted.score(encoded, ["id"]).where("scores[0] > 0.5").collect()}
    assert high == {7, 20_007}


def test_many_values_become_quantiles(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 > 0, F.col("id") * 1.0).alias("v"), F.lit(2.0).alias("w"))
    b = binned.fit_binning(df, ["v", "w"], [], max_bins=16)
    assert len(b.cuts[0]) == 15 and len(b.cuts[1]) == 0
    codes = binned.encode(df, b, ["id"])
    counts = binned.code_counts(codes, b)[0]
    assert counts[0][0] == 500 and counts[0][1:].min() > 200 and counts[1].tolist() == [0, 5000]


def test_empty_and_one_class(spark):
    df = table(spark).withColumn("a", F.lit(1))
    fitted, encoded = boost.fit_table(df, "id", ["a"], ["x"], [], boost.Settings(rounds=2, depth=2))
    assert all(0 <= r["scores"][0] <= 1 for r in fitted.score(encoded, ["id"]).collect())
    none, encoded = boost.fit_table(df.where("id < 0"), "id", ["a"], ["x"], ["kind"], boost.Settings(rounds=2, depth=2))
    assert fitted.trees and none.score(encoded, ["id"]).collect() == []


def test_sums_do_not_depend_on_blocks(spark, monkeypatch):
    df, settings = table(spark, 120, 8), boost.Settings(rounds=2, depth=2)
    one, _ = boost.fit_table(df, "id", ["a"], ["x", "z"], ["kind"], settings)
    monkeypatch.setattr(boost, "BLOCK_ROWS", 5)
    monkeypatch.setattr(boost, "DIRECT", 2)
    many, _ = boost.fit_table(df, "id", ["a"], ["x", "z"], ["kind"], settings)
    assert all(a.feature.shape[1] > 1 and (a.feature == b.feature).all() and np.allclose(a.value, b.value) for a, b in zip(one.trees, many.trees))


def test_walk_of_an_unsplit_tree():
    tree = trees.Trees.roots(2)
    assert tree.walk(np.zeros((3, 1), np.uint16), np.ones((2, 1), int), np.array([True])).tolist() == [[0, 0]] * 3
