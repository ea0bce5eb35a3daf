"""Name resolution and cohort selection."""

import pytest
from pyspark.sql import functions as F

from casesignal.bounds import check_size
from casesignal.operators import cohort, names

DIM = [(0, "Semaglutide"), (1, "Metformin"), (2, "Red Plate"), (3, "Tide")]
NAMES = {
    None: None,
    "": None,
    "-": None,
    "semaglutide": "Semaglutide",
    "Semaglutide-inj": "Semaglutide",
    "ozempic pen": "Semaglutide",
    "x metformin y": "Metformin",
    "METFORMIN\\SITAGLIPTIN": "Metformin",
    "metformin semaglutide": "Metformin",
    "a semaglutide metformin": "Semaglutide",
    " Red_Plate ": "Red Plate",
    "red  plate": None,
    "xtidex": "Tide",
    "JANUVIA": "Sitagliptin",
    "no match": None,
}


@pytest.mark.parametrize("inline_rows", [256, 0])
def test_cascade(spark, inline_rows):
    dim = spark.createDataFrame(DIM, "ordinal int, drug_name string")
    df = spark.createDataFrame([(n,) for n in NAMES] * 2, "n string")
    got = names.resolve_names(df, "n", dim, ordinal="ordinal", inline_rows=inline_rows)
    rows = got.collect()
    assert len(rows) == 2 * len(NAMES)
    assert {r["n"]: r["drug_mapped"] for r in rows} == NAMES
    kept = names.resolve_names(
        df, "n", dim, ordinal="ordinal", inline_rows=inline_rows, keep_unmatched=False
    )
    assert kept.count() == 2 * sum(v is not None for v in NAMES.values())


def test_cascade_needs_no_shuffle_for_a_small_dimension(spark):
    dim = spark.createDataFrame(DIM, "ordinal int, drug_name string")
    df = spark.range(10).select(F.col("id").cast("string").alias("n"))
    plan = names.resolve_names(df, "n", dim, ordinal="ordinal")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_brand_map_dict_and_table(spark):
    df = spark.createDataFrame([("OZEMPIC",), ("OTHER",), (None,)], "n string")
    table = spark.createDataFrame([("OZEMPIC", "SEMAGLUTIDE")], "key string, value string")
    want = {"OZEMPIC": "SEMAGLUTIDE", "OTHER": "OTHER", None: None}
    for mapping in ({"OZEMPIC": "SEMAGLUTIDE"}, table):
        assert {r["n"]: r["g"] for r in names.map_brand(df, "n", "g", mapping).collect()} == want


def test_std_name_provenance(spark):
    df = spark.createDataFrame([(" a ",)], "name string")
    named, used = names.add_std_name(df, ["DRUGNAME", "name"])
    assert used == "name" and named.first()["NAME_STD"] == "A"
    none, used = names.add_std_name(df, ["DRUGNAME"])
    assert used is None and none.first()["NAME_STD"] is None


def test_unmatched_keeps_null(spark):
    df = spark.createDataFrame([("A",), ("B",), ("B",), (None,)], "n string")
    dim = spark.createDataFrame([("A",)], "k string")
    got = cohort.unmatched_names(df, "n", dim, "k", ["n"]).collect()
    assert sorted(str(r["n"]) for r in got) == ["B", "None"]


def test_prefer_role_falls_back(spark):
    df = spark.createDataFrame([("SS",), ("C",), (None,)], "r string")
    assert cohort.prefer_role(df, "r").count() == 3
    assert cohort.prefer_role(df.unionByName(spark.createDataFrame([("ps",)], "r string")), "r").count() == 1
    assert cohort.prefer_role(df, None).count() == 3


def test_pick_primary(spark):
    rows = [(1, "C", "a"), (1, "SS", "z"), (1, "SS", "b"), (2, "I", "x"), (2, None, "w"), (3, "PS", None)]
    got = cohort.pick_primary(spark.createDataFrame(rows, "c int, r string, n string"), "c", "r", "n")
    assert {r["c"]: r["picked_drug"] for r in got.collect()} == {1: "b", 2: "w"}


def test_large_dimension_is_not_broadcast(spark):
    big = check_size(spark.range(50), limit=10)
    assert not big.small and big.side() is big.df
    small = check_size(spark.range(5), limit=10)
    assert small.small and len(small.rows) == 5


@pytest.mark.parametrize("ordinal", [None, "place"])
def test_odd_dimension_names_mean_the_same_on_both_paths(spark, ordinal):
    dim = spark.createDataFrame(
        [("", 1), (None, 2), ("Alpha", None), ("ALPHA", 3), ("lph", 1), ("beta", 4), ("bet", None)], "drug_name string, place int"
    )
    df = spark.createDataFrame([(x,) for x in ["", None, "alpha", "x alphabet", "betas", "zlphz", "none"]], "DRUGNAME string")
    got = [
        sorted(map(str, names.resolve_names(df, "DRUGNAME", dim, ordinal=ordinal, inline_rows=n).collect())) for n in (256, 0)
    ]
    assert got[0] == got[1]


def test_wide_rows_are_not_fetched(spark):
    wide = spark.range(3000).select(F.repeat(F.lit("x"), 20_000).alias("t"))
    assert not check_size(wide).small and check_size(wide.limit(50)).small
