"""Raw text to stored results, end to end."""

import pytest

from casesignal.operators import splits
from casesignal.plans import models, pipeline, train
from casesignal.sources.contract import MissingColumns, require_columns, with_first_names
from casesignal.sources.tables import load_pipeline, read_parquet

COMPOUNDS = (
    "drug_name,smiles,mol_weight,logP,TPSA,HBD,HBA,ATC,mechanism_tags\n"
    "Semaglutide,CC,4113.64,-5.8,1646.18,57,63,A10BJ06,GLP1_AGONIST\n"
    "Metformin,CN,129.16,-1.3,91.5,3,1,A10BA02,AMPK_ACTIVATION\n"
)


def write_raw(root):
    demo, drug, reac = (["primaryid$caseid$age$age_cod$sex$fda_dt"], ["primaryid$drugname$role_cod"], ["primaryid$pt"])
    for i in range(60):
        demo.append(f"{i}$c{i}${20 + i}$YR${'FM'[i % 2]}$202504{1 + i % 28:02d}")
        drug.append(f"{i}${('Ozempic', 'metformin hcl', 'water')[i % 3]}$PS")
        drug.append(f"{i}$METFORMIN$C")
        reac.append(f"{i}$Nausea")
        if i % 2:
            reac.append(f"{i}$Headache")
    (root / "q").mkdir(parents=True)
    for name, lines in (("DEMO", demo), ("DRUG", drug), ("REAC", reac)):
        (root / "q" / f"{name}_all.txt").write_text("\n".join(lines) + "\n")
    (root / "compounds.csv").write_text(COMPOUNDS)


def test_tables_with_other_column_names(spark, tmp_path):
    """The plans find columns under their other names, the first choice first."""
    raw, clean, out = tmp_path / "raw", str(tmp_path / "clean"), str(tmp_path / "out")
    write_raw(raw)
    dims = str(raw / "compounds.csv")
    pipeline.clean(spark, str(raw), clean)
    pipeline.run_signals(spark, clean, dims, f"{out}/a")
    other = str(tmp_path / "other")
    names = {"demo": {"PRIMARYID": "PrimaryID", "AGE": "age_yrs", "SEX": "gender"}, "drug": {"PRIMARYID": "CASEID", "DRUGNAME": "prod_ai", "ROLE_COD": "role"}, "reac": {"PRIMARYID": "PrimaryID", "PT": "reactionmeddrapt"}}
    for table, new in names.items():
        spark.read.parquet(f"{clean}/{table}").withColumnsRenamed(new).write.parquet(f"{other}/{table}")
    pipeline.run_signals(spark, other, dims, f"{out}/b")
    want, got = (sorted(map(str, spark.read.option("header", True).csv(f"{out}/{x}/signals").collect())) for x in "ab")
    assert want == got and want
    assert sorted(read_parquet(spark, f"{out}/b/y").columns) == sorted(read_parquet(spark, f"{out}/a/y").columns)


def test_first_names(spark):
    df = spark.createDataFrame([(1, "raw", "STD", "x")], "id int, DRUGNAME string, DRUGNAME_STD string, `a.b` string")
    got = with_first_names(df, pipeline.NAMES["DRUG"])
    assert got.columns == ["id", "DRUGNAME", "a.b"] and got.first()["DRUGNAME"] == "STD"
    assert with_first_names(df, {"x": ("nothing",)}).columns == df.columns
    with pytest.raises(MissingColumns, match="DRUG lacks PRIMARYID, ROLE_COD"):
        require_columns(got, pipeline.REQUIRED["DRUG"], "DRUG")


def test_end_to_end(spark, tmp_path):
    raw, clean, out = tmp_path / "raw", str(tmp_path / "clean"), str(tmp_path / "out")
    write_raw(raw)
    dims = str(raw / "compounds.csv")
    pipeline.clean(spark, str(raw), clean)
    pipeline.run_signals(spark, clean, dims, out)
    pipeline.run_metrics(spark, clean, dims, out)
    pipeline.run_case_features(spark, clean, dims, out)

    signals = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/signals").collect()
    got = {(r["drug_mapped"], r["PT"]): (r["a"], r["b"], r["c"], r["d"]) for r in signals}
    assert got["Semaglutide", "Headache"] == (10, 10, 20, 20)
    assert got["Metformin", "Nausea"] == (60, 0, 0, 0)
    assert read_parquet(spark, f"{out}/y").count() == 90
    # 20 x semaglutide and 60 + 20 x metformin rows, times 1.5 outcomes.
    assert read_parquet(spark, f"{out}/merged").count() == 150
    assert {r["QTR"] for r in read_parquet(spark, f"{out}/x").select("QTR").distinct().collect()} == {2}
    rolled = spark.read.option("header", True).csv(f"{out}/rolled_up").collect()
    assert {r["GENERIC_STD"]: r["n_reports"] for r in rolled} == {"SEMAGLUTIDE": "20"}
    v2 = read_parquet(spark, f"{out}/features_v2")
    assert v2.count() == 60 and v2.where("age_bin IS NULL").count() == 0
    assert read_parquet(spark, f"{out}/context").count() == 60
    assert read_parquet(spark, f"{out}/features_v1").count() == 60


def test_model_sinks(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "double(id % 10) AS x", "int(id % 10 > 4) AS y")
    pairs = rows.where("y = 1").selectExpr("id", "'hi' AS pt").unionByName(rows.selectExpr("id", "'all' AS pt"))
    parts = splits.nested(rows, "id", 1, ["y"])
    features = train.FeatureSet(("x",))
    small = train.forest(trees=3, depth=3, min_leaf=1)
    tuned = train.tune_and_refit(parts, "id", "y", "part", features, small, fill="zero")
    pipeline.write_tuned(tuned, str(tmp_path / "t"))
    assert read_parquet(spark, str(tmp_path / "t/threshold")).first()["threshold"] == tuned.threshold
    assert load_pipeline(str(tmp_path / "t/model")).transform(rows).count() == 200
    assert read_parquet(spark, str(tmp_path / "t/importances")).first()["feature"] == "x"
    models = train.train_per_label(parts, pairs, "id", "pt", ["hi"], "part", features, small, fill="zero")
    pipeline.write_label_models(models, str(tmp_path / "l"))
    assert read_parquet(spark, str(tmp_path / "l/thresholds")).count() == 1


def test_model_flows_end_to_end(spark, tmp_path):
    """From the raw files to every stored result, at small sizes."""
    raw, clean, out = tmp_path / "raw", str(tmp_path / "clean"), str(tmp_path / "out")
    write_raw(raw)
    dims = str(raw / "compounds.csv")
    pipeline.clean(spark, str(raw), clean)
    pipeline.run_metrics(spark, clean, dims, out)
    pipeline.run_case_features(spark, clean, dims, out)
    models.run_correlations(spark, out)
    models.run_case_models(spark, out, ["age", "logP_mean", "n_diab_records"], max_iter=20, trees=3, folds=2, rounds=2)
    models.run_label_models(spark, clean, dims, out, rounds=2, trees=2, nbits=16, top_labels=2, forest_labels=2)
    models.run_binary_model(spark, clean, dims, out, trees=2)
    read = lambda p: spark.read.option("header", True).csv(f"{out}/{p}")
    assert {r["class"] for r in read("logistic/report").collect()} >= {"0", "1", "accuracy"}
    assert read("boosted/folds").count() == 2 and read("forest/features").count() > 0
    for path in ("boosted_labels", "forest_labels"):
        assert {r.label for r in read_parquet(spark, f"{out}/{path}/thresholds").collect()} == {"Nausea", "Headache"}
    predicted = read_parquet(spark, f"{out}/boosted/predictions")
    assert predicted.count() == predicted.select("PRIMARYID").distinct().count() == 60
    assert read_parquet(spark, f"{out}/binary/threshold").count() == 1 and read("binary/metrics").count() == 1
