"""Disproportionality: 2x2 counts, PRR and ROR with 95 % intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casesignal.session import stored

Z_95 = 1.96
CELL_CORRECTION = 0.5


def contingency(pairs: DataFrame, case_id: str, exposure: str, outcome: str) -> DataFrame:
    """a, b, c, d per (exposure, outcome) over distinct cases.

    ``pairs`` is any table of case x exposure x outcome rows. N counts every
    case of the table. The distinct rows are stored once and counted four ways.
    """
    rows = stored(pairs.select(case_id, exposure, outcome).distinct(), "triples")
    has_exposure, has_outcome = F.col(exposure).isNotNull(), F.col(outcome).isNotNull()
    joint = rows.where(has_exposure & has_outcome).groupBy(exposure, outcome).agg(
        F.count(case_id).alias("a")
    )
    by_exposure = rows.where(has_exposure).groupBy(exposure).agg(
        F.count_distinct(case_id).alias("n_exposure")
    )
    by_outcome = rows.where(has_outcome).groupBy(outcome).agg(
        F.count_distinct(case_id).alias("n_outcome")
    )
    total = rows.agg(F.count_distinct(case_id)).scalar()
    table = joint.join(by_exposure, exposure).join(by_outcome, outcome).withColumn("n", total)
    return _cells(table, exposure, outcome)


def marked(df: DataFrame, case_id: str, value: str, mark: str) -> DataFrame:
    """Distinct (case, value); ``mark`` is 1 for the first value of a case, else 0."""
    pairs = df.where(F.col(case_id).isNotNull() & F.col(value).isNotNull()).select(case_id, value).distinct()
    first = pairs.groupBy(F.col(case_id).alias("__case")).agg(F.min(value).alias("__first"))
    return pairs.join(first, F.col(case_id) == F.col("__case")).select(
        case_id, value, (F.col(value) == F.col("__first")).cast("long").alias(mark)
    )


def contingency_from_sides(
    exposures: DataFrame, outcomes: DataFrame, case_id: str, exposure: str, outcome: str
) -> DataFrame:
    """Same counts straight from the two sides, N = cases present on both.

    Both sides are reduced to distinct pairs before the join, so a case brings
    at most |exposure names| x |outcome terms| rows. The first exposure and the
    first outcome of each case are marked; summing the marks over the joined
    rows gives both margins and N, so the joined rows are aggregated once. That
    (exposure, outcome) table is stored; the rest works on it alone. The first
    values are combined before they are shuffled and joined back, so no window
    holds a case: a case with very many values can be split over tasks.
    """
    e, o = marked(exposures, case_id, exposure, "__e1"), marked(outcomes, case_id, outcome, "__o1")
    joined = e.join(o, case_id)
    counted = joined.groupBy(exposure, outcome).agg(
        F.count(F.lit(1)).alias("a"),
        F.sum("__o1").alias("__e_cases"),
        F.sum("__e1").alias("__o_cases"),
        F.sum(F.col("__e1") * F.col("__o1")).alias("__cases"),
    )
    cells = stored(counted, "cells")
    by_exposure = cells.groupBy(exposure).agg(F.sum("__e_cases").alias("n_exposure"))
    by_outcome = cells.groupBy(outcome).agg(F.sum("__o_cases").alias("n_outcome"))
    total = cells.agg(F.sum("__cases")).scalar()
    table = (
        cells.select(exposure, outcome, "a")
        .join(by_exposure, exposure)
        .join(by_outcome, outcome)
        .withColumn("n", total)
    )
    return _cells(table, exposure, outcome)


def _cells(table: DataFrame, exposure: str, outcome: str) -> DataFrame:
    a, b, c = F.col("a"), F.col("n_exposure") - F.col("a"), F.col("n_outcome") - F.col("a")
    return table.select(
        exposure,
        outcome,
        a.alias("a"),
        b.alias("b"),
        c.alias("c"),
        (F.col("n") - a - b - c).alias("d"),
    )


def prr_ror(counts: DataFrame, correction: float = CELL_CORRECTION, z: float = Z_95) -> DataFrame:
    """Add PRR and ROR with their intervals; every cell gets the correction."""
    a, b, c, d = (F.col(k) + F.lit(correction) for k in "abcd")
    prr = (a / (a + b)) / (c / (c + d))
    ror = (a * d) / (b * c)
    prr_se = F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))
    ror_se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)

    def interval(name: str, value, se):
        return [
            value.alias(name),
            F.exp(F.log(value) - z * se).alias(f"{name}_L"),
            F.exp(F.log(value) + z * se).alias(f"{name}_H"),
        ]

    return counts.select("*", *interval("PRR", prr, prr_se), *interval("ROR", ror, ror_se))
