"""The joins of the case-report model, all on equal keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casesignal.bounds import Dimension, check_size


def pair_with_outcomes(
    exposures: DataFrame,
    outcomes: DataFrame,
    case_id: str,
    exposure: str,
    outcome: str,
) -> DataFrame:
    """Exposure x outcome rows of each case, duplicates kept, nulls dropped.

    The null filters run before the join; a case with very many rows is split
    by the adaptive skew join.
    """
    left = exposures.where(F.col(exposure).isNotNull()).select(case_id, exposure)
    right = outcomes.where(F.col(outcome).isNotNull()).select(case_id, outcome)
    return left.join(right, case_id)


def attach(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join of a table that has one row per key."""
    return left.join(right, on if isinstance(on, str) else list(on), "left")


def attach_dimension(
    df: DataFrame, dim: DataFrame | Dimension, name: str, dim_name: str
) -> DataFrame:
    """Left join of the dimension on its name; broadcast if its size allows."""
    side = check_size(dim).side()
    if dim_name != name:
        side = side.withColumnRenamed(dim_name, name)
    return df.join(side, name, "left")


def merge_outer(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Full outer join with one key column."""
    return left.join(right, on, "full")


def restrict_to(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return df.join(keys, on if isinstance(on, str) else list(on), "left_semi")


def common_keys(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Distinct keys found on both sides."""
    return left.select(on).intersect(right.select(on))


def duplicate_keys(df: DataFrame, on: str) -> DataFrame:
    """Keys with more than one row: what a left join would multiply."""
    return df.groupBy(on).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
