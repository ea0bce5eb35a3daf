"""Contingency counts and signals against brute force."""

import math
import random

from casesignal.operators import relate, signals


def brute(pairs):
    cases = {c for c, _, _ in pairs}
    out = {}
    for d in {p[1] for p in pairs}:
        for t in {p[2] for p in pairs}:
            with_d = {c for c, x, _ in pairs if x == d}
            with_t = {c for c, _, y in pairs if y == t}
            a = len({c for c, x, y in pairs if (x, y) == (d, t)})
            if a:
                b, c = len(with_d) - a, len(with_t) - a
                out[d, t] = (a, b, c, len(cases) - a - b - c)
    return out


def make(seed=3):
    rnd = random.Random(seed)
    drugs = [(rnd.randrange(60), rnd.choice(["d1", "d2", "d3", None])) for _ in range(150)]
    drugs += [(7, "d1")] * 80
    terms = [(rnd.randrange(70), rnd.choice(["t1", "t2", "t3", "t4", None])) for _ in range(150)]
    return drugs, terms


def cells(df):
    return {(r["drug"], r["pt"]): (r["a"], r["b"], r["c"], r["d"]) for r in df.collect()}


def test_both_paths_match_brute_force(spark):
    drugs, terms = make()
    drug = spark.createDataFrame(drugs, "case long, drug string")
    reac = spark.createDataFrame(terms, "case long, pt string")
    pairs = [(c, d, t) for c, d in drugs if d for k, t in terms if t and k == c]
    want = brute(pairs)
    merged = relate.pair_with_outcomes(drug, reac, "case", "drug", "pt")
    assert merged.count() == len(pairs)
    assert cells(signals.contingency(merged, "case", "drug", "pt")) == want
    assert cells(signals.contingency_from_sides(drug, reac, "case", "drug", "pt")) == want


def test_measures(spark):
    rows = [("x", "y", 10, 0, 0, 0), ("x", "z", 3, 7, 11, 200)]
    counts = spark.createDataFrame(rows, "drug string, pt string, a long, b long, c long, d long")
    got = {r["pt"]: r for r in signals.prr_ror(counts).collect()}
    a, b, c, d = 3.5, 7.5, 11.5, 200.5
    prr, ror = (a / (a + b)) / (c / (c + d)), a * d / (b * c)
    se = math.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    assert math.isclose(got["z"]["PRR"], prr) and math.isclose(got["z"]["ROR"], ror)
    assert math.isclose(got["z"]["PRR_L"], math.exp(math.log(prr) - 1.96 * se))
    for r in got.values():
        assert r["PRR_L"] <= r["PRR"] <= r["PRR_H"] and r["ROR_L"] <= r["ROR"] <= r["ROR_H"]


def test_one_case_of_very_many_values(spark, capsys):
    """A third of all rows in one case: exact margins, and no window that would hold the case in one task."""
    hot = spark.range(100_000).selectExpr("1L AS case", "concat('x', id) AS drug")
    cold = spark.range(200_000).selectExpr("id + 2 AS case", "concat('x', id % 50) AS drug")
    drug = hot.unionByName(cold).unionByName(hot.limit(10))
    reac = spark.createDataFrame([(1, "t1"), (1, "t2"), (None, "t1"), (2, "t1"), (52, "t1"), (-5, "t2")], "case long, pt string")
    table = signals.contingency_from_sides(drug, reac, "case", "drug", "pt")
    got = cells(table.where("drug IN ('x0', 'x1', 'x99999')"))
    # Three cases on both sides: 1, 2 and 52; x0 in all of them.
    assert got == {
        ("x0", "t1"): (3, 0, 0, 0), ("x0", "t2"): (1, 2, 0, 0), ("x1", "t1"): (1, 0, 2, 0), ("x1", "t2"): (1, 0, 0, 2),
        ("x99999", "t1"): (1, 0, 2, 0), ("x99999", "t2"): (1, 0, 0, 2),
    }
    assert table.count() == 200_000
    capsys.readouterr()
    signals.marked(drug, "case", "drug", "m").explain()
    assert "Window" not in capsys.readouterr().out
