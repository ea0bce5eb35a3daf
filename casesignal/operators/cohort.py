"""Cohort selection: terms, allow-lists, roles and one exposure per case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casesignal.bounds import Dimension, check_size
from casesignal.functions import text
from casesignal.functions.vocab import COHORT_TERMS, OTHER_ROLE_RANK, ROLE_RANK


def match_terms(
    df: DataFrame, name: str, terms: Sequence[str] = COHORT_TERMS, out: str = "in_cohort"
) -> DataFrame:
    """Flag rows whose name holds any term; a null name is not in the cohort."""
    return df.withColumn(out, text.contains_any(F.col(name), tuple(terms)))


def allow_list(df: DataFrame, name: str, dim: DataFrame | Dimension, dim_name: str) -> DataFrame:
    """Rows whose name is a dimension name."""
    side = check_size(dim).select(F.col(dim_name).alias(name)).side()
    return df.join(side, name, "left_semi")


def not_allowed(df: DataFrame, name: str, dim: DataFrame | Dimension, dim_name: str) -> DataFrame:
    """Rows whose name is no dimension name; a null name is kept."""
    side = check_size(dim).select(F.col(dim_name).alias(name)).side()
    return df.join(side, name, "left_anti")


def unmatched_names(
    df: DataFrame, name: str, dim: DataFrame | Dimension, dim_name: str, keep: Sequence[str]
) -> DataFrame:
    """Distinct ``keep`` columns of the rows outside the allow-list."""
    return not_allowed(df, name, dim, dim_name).select(*keep).distinct()


def keep_roles(df: DataFrame, role: str, roles: Sequence[str] = tuple(ROLE_RANK)) -> DataFrame:
    return df.where(F.col(role).isin(list(roles)))


def prefer_role(df: DataFrame, role: str | None, wanted: str = "PS") -> DataFrame:
    """Rows with the wanted role; all rows if the whole set has none.

    The test for "none" is a one-value subquery, so the filter stays narrow.
    """
    if role is None:
        return df
    is_wanted = F.coalesce(F.upper(role) == wanted, F.lit(False))
    any_wanted = df.agg(F.coalesce(F.max(is_wanted), F.lit(False))).scalar()
    return df.where(is_wanted | ~any_wanted)


def role_rank(role: Column, ranks: Mapping[str, int] = ROLE_RANK) -> Column:
    out = F.lit(OTHER_ROLE_RANK)
    for code, rank in ranks.items():
        out = F.when(role == code, F.lit(rank)).otherwise(out)
    return out


def pick_primary(
    df: DataFrame, case_id: str, role: str, name: str, out: str = "picked_drug"
) -> DataFrame:
    """One resolved name per case: best role first, then by name.

    A struct minimum, so rows are combined before the shuffle.
    """
    best = F.min(F.struct(role_rank(F.col(role)).alias("rank"), F.col(name).alias("name")))
    return (
        df.where(F.col(name).isNotNull() & F.col(case_id).isNotNull())
        .groupBy(case_id)
        .agg(best.alias("__best"))
        .select(case_id, F.col("__best.name").alias(out))
    )


def cohort_counts(df: DataFrame, case_id: str) -> DataFrame:
    """Number of records and of distinct cases, as one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_records"), F.count_distinct(case_id).alias("n_cases")
    )
