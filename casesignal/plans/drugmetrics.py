"""Exposure-level metrics, their allow-list split and the generic roll-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casesignal.bounds import Dimension, check_size
from casesignal.functions.scalars import ratio_if_positive
from casesignal.functions.text import std_name
from casesignal.functions.vocab import BRAND_TO_GENERIC, COHORT_TERMS, PROPERTIES
from casesignal.operators import aggregate, cohort, names, relate
from casesignal.session import stored


def drug_metrics(
    drug: DataFrame,
    reac: DataFrame,
    dim: DataFrame | Dimension,
    case_id: str = "PRIMARYID",
    name: str = "DRUGNAME",
    role: str | None = "ROLE_COD",
    outcome: str = "PT",
    dim_name: str = "drug_name",
    terms: Sequence[str] = COHORT_TERMS,
    out: str = "DRUGNAME_STD",
) -> DataFrame:
    """Reports, outcomes and outcome diversity per standard name.

    ``total_adr`` adds the outcome rows of a case once per exposure row, so a
    case that names the exposure twice counts twice; that is its definition.
    Exposure rows are counted per (name, case) and stored before the joins,
    which brings the same sums from far fewer rows and one scan.
    """
    named = drug.withColumn(out, std_name(F.col(name)))
    hits = cohort.match_terms(named, out, terms).where("in_cohort")
    roles = [] if role is None else [role]
    facts = aggregate.keyed(hits, out).groupBy(out, case_id, *roles).agg(F.count(F.lit(1)).alias("__n"))
    chosen = cohort.prefer_role(stored(facts, "hits"), role)
    per_case = chosen.groupBy(out, case_id).agg(F.sum("__n").alias("__rows"))
    counts = aggregate.rows_per(reac, case_id, "__adr")
    totals = (
        relate.attach(per_case, counts, case_id)
        .groupBy(out)
        .agg(
            F.count(case_id).alias("n_reports"),
            aggregate.sum_or_zero(F.col("__rows") * F.col("__adr")).alias("total_adr"),
        )
        .withColumn("mean_ADR_per_case", ratio_if_positive(F.col("total_adr"), F.col("n_reports")))
    )
    terms_of = reac.where(F.col(outcome).isNotNull()).select(case_id, outcome).distinct()
    seen = per_case.select(out, case_id).join(terms_of, case_id)
    diversity = seen.groupBy(out).agg(F.count_distinct(outcome).alias("unique_PT_count"))
    metrics = relate.attach(totals, diversity, out).withColumn(
        "unique_PT_count", F.coalesce("unique_PT_count", F.lit(0))
    )
    keyed_dim = check_size(dim).select("*", std_name(F.col(dim_name)).alias(out))
    return metrics.join(keyed_dim.side(), out, "left")


def by_reports(metrics: DataFrame, name: str = "DRUGNAME_STD") -> DataFrame:
    """Most reports first, then most outcomes, then by name."""
    return metrics.orderBy(F.desc("n_reports"), F.desc("total_adr"), F.asc(name))


def split_matched(
    metrics: DataFrame,
    dim: DataFrame | Dimension,
    name: str = "DRUGNAME_STD",
    dim_name: str = "drug_name",
    mapping: Mapping[str, str] | DataFrame = BRAND_TO_GENERIC,
) -> tuple[DataFrame, DataFrame]:
    """(clean, unmatched) by whether the mapped name is a dimension name."""
    allowed = check_size(dim).select(std_name(F.col(dim_name)).alias("__allowed"))
    named = metrics.withColumn("NAME_STD", std_name(F.col(name)))
    mapped = names.map_brand(named, "NAME_STD", "NAME_STD_MAP", mapping)
    clean = cohort.allow_list(mapped, "NAME_STD_MAP", allowed, "__allowed").withColumn(
        "GENERIC_STD", F.col("NAME_STD_MAP")
    )
    unmatched = cohort.unmatched_names(mapped, "NAME_STD_MAP", allowed, "__allowed", [name, "NAME_STD"])
    return clean, unmatched


def rollup_generic(
    clean: DataFrame,
    name: str = "DRUGNAME_STD",
    generic: str = "GENERIC_STD",
    properties: Sequence[str] = PROPERTIES,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Sums by generic name; diversity is the mean over the names merged.

    Properties are the first non-null ones in the given order (by name unless
    told otherwise).
    """
    order = list(order or [name])
    if generic in clean.columns:
        clean = clean.withColumn(generic, F.coalesce(generic, name))
    else:
        clean = clean.withColumn(generic, F.col(name))
    merged = (
        aggregate.keyed(clean, generic)
        .groupBy(generic)
        .agg(
            aggregate.sum_or_zero("n_reports").alias("n_reports"),
            aggregate.sum_or_zero("total_adr").alias("total_adr"),
            F.avg("unique_PT_count").alias("unique_PT_count"),
            *[aggregate.first_non_null(p, order).alias(p) for p in properties],
        )
    )
    return merged.withColumn(
        "mean_ADR_per_case", ratio_if_positive(F.col("total_adr"), F.col("n_reports"))
    )
