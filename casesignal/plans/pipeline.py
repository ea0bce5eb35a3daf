"""End-to-end runs from raw text to stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casesignal.plans import casefeatures, drugmetrics, signals, train
from casesignal.sources.contract import require_columns, with_first_names
from casesignal.sources.tables import COMPOUND_SCHEMA, read_csv, read_parquet, write_csv, write_parquet
from casesignal.sources.text import CASE_TABLES, read_case_table

REQUIRED = {
    "DEMO": ("PRIMARYID", "AGE", "AGE_COD", "SEX", "FDA_DT"),
    "DRUG": ("PRIMARYID", "DRUGNAME", "ROLE_COD"),
    "REAC": ("PRIMARYID", "PT"),
}

# Names under which the tables are known to hold a column, first choice first.
_CASE = ("PRIMARYID", "primaryid", "PrimaryID", "CASEID", "caseid")
NAMES = {
    "DEMO": {
        "PRIMARYID": _CASE,
        "AGE": ("AGE", "age", "AGE_YRS", "age_yrs"),
        "SEX": ("SEX", "sex", "GENDER", "gender"),
    },
    "DRUG": {
        "PRIMARYID": _CASE,
        "DRUGNAME": ("DRUGNAME_STD", "DRUGNAME", "drugname", "SUBSTANCENAME", "PROD_AI", "prod_ai", "MEDICINALPRODUCT"),
        "ROLE_COD": ("ROLE_COD", "role_cod", "ROLE", "role"),
        "ROUTE": ("ROUTE", "route", "ROUTE_COD", "route_cod"),
    },
    "REAC": {"PRIMARYID": _CASE, "PT": ("PT", "pt", "reactionmeddrapt", "REAC_PT")},
}


def clean(spark: SparkSession, raw: str, out: str) -> None:
    """Delimited text files to one clean parquet table each."""
    for prefix in CASE_TABLES:
        table = read_case_table(spark, raw, prefix)
        write_parquet(table.rows, f"{out}/{prefix.lower()}")
        write_parquet(table.rejected, f"{out}/{prefix.lower()}_rejected")


def read_clean(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The clean tables, their columns found by ``NAMES`` and checked for what the pipelines need."""
    tables = {prefix: read_parquet(spark, f"{root}/{prefix.lower()}") for prefix in REQUIRED}
    return {p: require_columns(with_first_names(t, NAMES[p]), REQUIRED[p], p) for p, t in tables.items()}


def compounds(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, COMPOUND_SCHEMA)


def run_signals(spark: SparkSession, root: str, compounds_csv: str, out: str) -> None:
    """Model tables x, y and merged, and the safety signals."""
    t, dim = read_clean(spark, root), compounds(spark, compounds_csv)
    tables = signals.model_tables(t["DEMO"], t["DRUG"], t["REAC"], dim)
    write_parquet(tables.x, f"{out}/x")
    write_parquet(tables.y, f"{out}/y")
    write_parquet(tables.merged, f"{out}/merged")
    write_csv(signals.safety_signals(t["DRUG"], t["REAC"], dim), f"{out}/signals")


def run_metrics(spark: SparkSession, root: str, compounds_csv: str, out: str) -> None:
    """Exposure metrics, their split by the dimension, and the roll-up."""
    t, dim = read_clean(spark, root), compounds(spark, compounds_csv)
    write_parquet(drugmetrics.drug_metrics(t["DRUG"], t["REAC"], dim), f"{out}/metrics")
    metrics = read_parquet(spark, f"{out}/metrics")
    kept, unmatched = drugmetrics.split_matched(metrics, dim)
    write_csv(drugmetrics.by_reports(metrics), f"{out}/metrics_csv")
    write_csv(kept, f"{out}/clean")
    write_csv(unmatched, f"{out}/unmatched")
    write_csv(drugmetrics.rollup_generic(kept), f"{out}/rolled_up")


def run_case_features(spark: SparkSession, root: str, compounds_csv: str, out: str) -> None:
    """Both case feature tables and the context features."""
    t, dim = read_clean(spark, root), compounds(spark, compounds_csv)
    demo, drug, reac = t["DEMO"], t["DRUG"], t["REAC"]
    route = "ROUTE" if "ROUTE" in drug.columns else None
    write_parquet(casefeatures.features_v1(drug, reac, dim, demo), f"{out}/features_v1")
    v2 = casefeatures.features_v2(drug, reac, dim, demo, route=route)
    write_parquet(v2, f"{out}/features_v2")
    context = casefeatures.context_features(demo, drug, reac, order=("FDA_DT",))
    write_parquet(context, f"{out}/context")


def write_label_models(models: train.LabelModels, out: str) -> None:
    """Thresholds, predictions, and the models with their preparation."""
    write_parquet(models.thresholds, f"{out}/thresholds")
    write_parquet(models.predictions, f"{out}/predictions")
    train.save(models, f"{out}/models")


def write_tuned(model: train.TunedModel, out: str) -> None:
    """Predictions, the threshold, the top importances and the pipeline."""
    spark = model.predictions.sparkSession
    write_parquet(model.predictions, f"{out}/predictions")
    write_parquet(spark.createDataFrame([(model.threshold,)], "threshold double"), f"{out}/threshold")
    top: list[tuple[str, float]] = train.importances(model.model.stages[-1], model.names)
    write_parquet(train.importance_table(spark, top, top=30), f"{out}/importances")
    model.model.write().overwrite().save(f"{out}/model")

