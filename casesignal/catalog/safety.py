"""Joins of the model tables and the disproportionality signals."""

from pyspark.sql import functions as F

from casesignal.catalog import adapters as a
from casesignal.catalog.registry import query
from casesignal.operators import relate, signals
from casesignal.plans import signals as plan


def model_tables(spark, sf):
    return plan.model_tables(
        a.demo(spark, sf), a.drug(spark, sf), a.reac(spark, sf), a.dim(spark, sf),
        ordinal="ordinal", synonyms=a.SYNONYMS,
    )


@query(
    "merged_cases",
    a.with_ctes(
        "merged",
        """SELECT drug_mapped, PT, SEX, AGE_COD, CAST(YEAR AS BIGINT) AS YEAR, CAST(QTR AS BIGINT) AS QTR,
        count(*) AS n, CAST(sum(AGE) AS DOUBLE) AS age_sum, count(DISTINCT PRIMARYID) AS n_cases
        FROM merged GROUP BY ALL""",
    ),
)
def merged_cases(spark, sf):
    """Every merged row, counted by its columns."""
    merged = model_tables(spark, sf).merged
    return merged.groupBy("drug_mapped", "PT", "SEX", "AGE_COD", "YEAR", "QTR").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("AGE").alias("age_sum"),
        F.count_distinct("PRIMARYID").alias("n_cases"),
    )


@query(
    "model_x",
    a.with_ctes(
        "merged dim",
        """SELECT drug_mapped, YEAR::BIGINT AS YEAR, ATC, mechanism_tags, round(mol_weight, 6) AS mol_weight,
        round(logP, 6) AS logP, CAST(sum(HBD) AS BIGINT) AS hbd_sum, CAST(sum(HBA) AS BIGINT) AS hba_sum, count(*) AS n
        FROM merged LEFT JOIN dim ON drug_name = drug_mapped GROUP BY ALL""",
    ),
)
def model_x(spark, sf):
    """Every row of X, counted by its dimension columns."""
    x = model_tables(spark, sf).x
    return x.groupBy("drug_mapped", "YEAR", "ATC", "mechanism_tags", "mol_weight", "logP").agg(
        F.sum("HBD").alias("hbd_sum"), F.sum("HBA").alias("hba_sum"), F.count(F.lit(1)).alias("n")
    )


@query("model_y", a.with_ctes("pairs", "SELECT DISTINCT PRIMARYID, PT FROM pairs"))
def model_y(spark, sf):
    """The 0/1 outcome matrix in long form."""
    return model_tables(spark, sf).y


@query(
    "case_name_pairs",
    a.with_ctes("mapped", "SELECT DISTINCT PRIMARYID, drug_mapped FROM mapped WHERE drug_mapped IS NOT NULL"),
)
def case_name_pairs(spark, sf):
    """Distinct projection of the mapped exposures."""
    from casesignal.operators import names

    mapped = names.resolve_names(
        a.drug(spark, sf), "DRUGNAME", a.dim(spark, sf), ordinal="ordinal", synonyms=a.SYNONYMS
    )
    return mapped.select("PRIMARYID", "drug_mapped").dropna().distinct()


@query(
    "common_cases",
    a.with_ctes(
        "demo_versions drug",
        "SELECT PRIMARYID FROM demo_versions INTERSECT SELECT PRIMARYID FROM drug",
    ),
)
def common_cases(spark, sf):
    return relate.common_keys(a.demo_versions(spark, sf), a.drug(spark, sf), "PRIMARYID")


@query(
    "outer_merge",
    a.with_ctes(
        "demo_versions drug",
        """SELECT coalesce(v.PRIMARYID, d.PRIMARYID) AS PRIMARYID, n_versions, n_rows FROM
        (SELECT PRIMARYID, count(*) AS n_versions FROM demo_versions GROUP BY 1) v FULL JOIN
        (SELECT PRIMARYID, count(*) AS n_rows FROM drug GROUP BY 1) d ON v.PRIMARYID = d.PRIMARYID""",
    ),
)
def outer_merge(spark, sf):
    left = a.demo_versions(spark, sf).groupBy("PRIMARYID").agg(F.count(F.lit(1)).alias("n_versions"))
    right = a.drug(spark, sf).groupBy("PRIMARYID").agg(F.count(F.lit(1)).alias("n_rows"))
    return relate.merge_outer(left, right, "PRIMARYID")


@query(
    "duplicate_reports",
    a.with_ctes(
        "demo_reports",
        "SELECT PRIMARYID, count(*) AS n_rows FROM demo_reports GROUP BY 1 HAVING count(*) > 1",
    ),
)
def duplicate_reports(spark, sf):
    """Keys that a left join would multiply."""
    return relate.duplicate_keys(a.demo_reports(spark, sf), "PRIMARYID")


_COUNTS = {
    "tot": "SELECT count(DISTINCT PRIMARYID) AS n FROM pairs",
    "nd": "SELECT drug_mapped, count(DISTINCT PRIMARYID) AS n FROM pairs GROUP BY 1",
    "np": "SELECT PT, count(DISTINCT PRIMARYID) AS n FROM pairs GROUP BY 1",
    "ab": "SELECT drug_mapped, PT, count(DISTINCT PRIMARYID) AS a FROM pairs GROUP BY 1, 2",
    "cells": """SELECT ab.drug_mapped, ab.PT, a, nd.n - a AS b, np.n - a AS c,
        tot.n - a - (nd.n - a) - (np.n - a) AS d
        FROM ab JOIN nd USING (drug_mapped) JOIN np USING (PT), tot""",
}
_CONTINGENCY = a.with_ctes("pairs", "SELECT * FROM cells", **_COUNTS)


@query("contingency", _CONTINGENCY)
def contingency(spark, sf):
    """Counts from the merged rows."""
    merged = model_tables(spark, sf).merged
    return signals.contingency(merged, "PRIMARYID", "drug_mapped", "PT")


@query("contingency_from_sides", _CONTINGENCY)
def contingency_from_sides(spark, sf):
    """The same counts without merging."""
    mapped = plan.mapped_exposures(
        a.drug(spark, sf), a.dim(spark, sf), ordinal="ordinal", synonyms=a.SYNONYMS
    )
    return signals.contingency_from_sides(mapped, a.reac(spark, sf), "PRIMARYID", "drug_mapped", "PT")


_MEASURES = """SELECT drug_mapped, PT, a, b, c, d,
    round(prr, 6) AS PRR, round(exp(ln(prr) - 1.96 * sp), 6) AS PRR_L, round(exp(ln(prr) + 1.96 * sp), 6) AS PRR_H,
    round(ror, 6) AS ROR, round(exp(ln(ror) - 1.96 * sr), 6) AS ROR_L, round(exp(ln(ror) + 1.96 * sr), 6) AS ROR_H
    FROM (SELECT *, (a1 / (a1 + b1)) / (c1 / (c1 + d1)) AS prr, (a1 * d1) / (b1 * c1) AS ror,
        sqrt(1 / a1 - 1 / (a1 + b1) + 1 / c1 - 1 / (c1 + d1)) AS sp,
        sqrt(1 / a1 + 1 / b1 + 1 / c1 + 1 / d1) AS sr
        FROM (SELECT *, CAST(a AS DOUBLE) + 0.5::DOUBLE AS a1, CAST(b AS DOUBLE) + 0.5::DOUBLE AS b1,
            CAST(c AS DOUBLE) + 0.5::DOUBLE AS c1, CAST(d AS DOUBLE) + 0.5::DOUBLE AS d1 FROM cells))"""


@query("disproportionality_signals", a.with_ctes("pairs", _MEASURES, **_COUNTS))
def disproportionality_signals(spark, sf):
    """PRR and ROR with intervals, from the raw tables."""
    return plan.safety_signals(
        a.drug(spark, sf), a.reac(spark, sf), a.dim(spark, sf),
        ordinal="ordinal", synonyms=a.SYNONYMS,
    )
