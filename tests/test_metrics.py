"""Drug-level metrics, with published values as goldens."""

import math

from casesignal.operators import labels
from casesignal.plans import drugmetrics

# Name, reports, outcomes, distinct terms, expected generic.
NAMES = [
    ("MOUNJARO", 7422, 15862, 1380, "TIRZEPATIDE"),
    ("DAPAGLIFLOZIN", 1671, 3241, 853, "DAPAGLIFLOZIN"),
    ("OZEMPIC", 1556, 5589, 1214, "SEMAGLUTIDE"),
    ("TRULICITY", 1102, 2792, 452, "DULAGLUTIDE"),
    ("WEGOVY", 681, 2022, 720, "SEMAGLUTIDE"),
    ("FARXIGA", 222, 776, 386, "DAPAGLIFLOZIN"),
    ("METFORMIN HYDROCHLORIDE", 216, 1316, 482, None),
    ("TIRZEPATIDE", 206, 612, 260, "TIRZEPATIDE"),
    ("RYBELSUS", 179, 538, 289, "SEMAGLUTIDE"),
    ("SEMAGLUTIDE", 156, 644, 323, "SEMAGLUTIDE"),
    ("BYDUREON BCISE", 105, 408, 128, None),
    ("BYETTA", 11, 34, 28, "EXENATIDE"),
    ("DULAGLUTIDE", 8, 13, 13, "DULAGLUTIDE"),
    ("ONGLYZA", 2, 6, 6, "SAXAGLIPTIN"),
    ("BYDUREON", 1, 9, 9, "EXENATIDE"),
    ("EXENATIDE", 1, 4, 4, "EXENATIDE"),
]
# Generic -> reports, outcomes, mean distinct terms, mean per case.
ROLLED = {
    "DAPAGLIFLOZIN": (1893, 4017, 619.5, 2.12202852614897),
    "DULAGLUTIDE": (1110, 2805, 232.5, 2.527027027027027),
    "EXENATIDE": (13, 47, 13.666666666666666, 3.6153846153846154),
    "SAXAGLIPTIN": (2, 6, 6.0, 3.0),
    "SEMAGLUTIDE": (2572, 8793, 636.5, 3.4187402799377917),
    "TIRZEPATIDE": (7628, 16474, 820.0, 2.159674882013634),
}
WEIGHTS = {"DAPAGLIFLOZIN": 408.9, "DULAGLUTIDE": 3314.6, "EXENATIDE": 4187.0,
           "SEMAGLUTIDE": 4113.64, "TIRZEPATIDE": 4813.0}


def test_split_and_rollup(spark):
    dim = spark.createDataFrame([(g.title(),) for g in ROLLED], "drug_name string")
    rows = [(n, r, t, u, WEIGHTS.get(n)) for n, r, t, u, _ in NAMES]
    metrics = spark.createDataFrame(
        rows, "DRUGNAME_STD string, n_reports long, total_adr long, unique_PT_count long, mol_weight double"
    )
    clean, unmatched = drugmetrics.split_matched(metrics, dim)
    assert {r["DRUGNAME_STD"]: r["GENERIC_STD"] for r in clean.collect()} == {
        n: g for n, *_, g in NAMES if g
    }
    assert {r["NAME_STD"] for r in unmatched.collect()} == {n for n, *_, g in NAMES if not g}
    rolled = drugmetrics.rollup_generic(clean, properties=["mol_weight"])
    got = {r["GENERIC_STD"]: r for r in rolled.collect()}
    assert set(got) == set(ROLLED)
    for generic, (reports, adr, terms, mean) in ROLLED.items():
        r = got[generic]
        assert (r["n_reports"], r["total_adr"]) == (reports, adr)
        assert math.isclose(r["unique_PT_count"], terms) and math.isclose(r["mean_ADR_per_case"], mean)
        assert r["mol_weight"] == WEIGHTS.get(generic)


def test_metrics_count_name_variants_twice(spark):
    drug = spark.createDataFrame(
        [(1, "Insulin", "PS"), (1, " insulin ", "PS"), (2, "insulin", "SS"), (3, "water", "PS"), (4, "INSULIN", "PS")],
        "PRIMARYID long, DRUGNAME string, ROLE_COD string",
    )
    reac = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "PRIMARYID long, PT string")
    dim = spark.createDataFrame([("Insulin", 5.0)], "drug_name string, mol_weight double")
    got = drugmetrics.drug_metrics(drug, reac, dim).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["n_reports"], r["total_adr"], r["unique_PT_count"], r["mol_weight"]) == (2, 4, 2, 5.0)
    assert r["mean_ADR_per_case"] == 2.0


def test_labels(spark):
    pairs = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, None), (5, "b")], "c long, pt string"
    )
    top = labels.top_labels(pairs, "c", "pt", 2).collect()
    assert [tuple(r) for r in top] == [("a", 2), ("b", 2)]
    matrix = {r["c"]: (r["a"], r["b"]) for r in labels.label_matrix(pairs, "c", "pt", ["a", "b"]).collect()}
    assert matrix == {1: (1, 1), 2: (1, 0), 3: (0, 0), 5: (0, 1)}
    multi = {r["c"]: r["y"] for r in labels.multi_vs_single(pairs, "c", "pt", 2).collect()}
    assert multi == {1: 1, 2: 0, 5: 0}
    cases = spark.createDataFrame([(i,) for i in range(1, 7)], "c long")
    counted = labels.with_multi_label(cases, labels.outcome_counts(pairs, "c"), "c")
    assert {r["c"]: (r["ADR_count"], r["y_multiADR"]) for r in counted.collect()} == {
        1: (3, 1), 2: (1, 0), 3: (1, 0), 4: (1, 0), 5: (1, 0), 6: (0, 0)
    }
