"""Aggregates with the null rules of the case-report model.

Null group keys are dropped. Every function combines rows before the shuffle,
so one key with very many rows does not land in one task uncombined.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casesignal.functions.text import count_tag


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with all keys present, as filters that reach the scan."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def rows_per(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Rows per key, whatever their other columns hold."""
    return keyed(df, key).groupBy(key).agg(F.count(F.lit(1)).alias(out))


def distinct_per(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Distinct non-null values per key."""
    return keyed(df, key).groupBy(key).agg(F.count_distinct(value).alias(out))


def sum_or_zero(c: Column | str) -> Column:
    """Sum that is 0 for a group without any value."""
    return F.coalesce(F.sum(c), F.lit(0))


def first_non_null(c: str, order: Sequence[str]) -> Column:
    """First non-null value in the given order."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))


def property_stats(wanted: Mapping[str, Sequence[str]]) -> list[Column]:
    """Aggregates named ``<column>_<stat>``; std is the sample deviation."""
    made = {
        "mean": F.avg,
        "max": F.max,
        "min": F.min,
        "sum": lambda c: sum_or_zero(F.col(c).cast("double")),
        "std": F.stddev_samp,
    }
    return [made[stat](col).alias(f"{col}_{stat}") for col, stats in wanted.items() for stat in stats]


def weighted_stats(wanted: Mapping[str, Sequence[str]], weight: str) -> list[Column]:
    """The same statistics for rows that each stand for ``weight`` equal ones.

    ``std`` needs the group's mean on every row as ``__mean_<column>``
    (:func:`weighted_mean` of the group); deviations from it are summed, so
    nothing cancels out.
    """
    out = []
    for col, stats in wanted.items():
        value, n = F.col(col).cast("double"), F.sum(F.when(F.col(col).isNotNull(), F.col(weight)))
        off = value - F.col(f"__mean_{col}")
        made = {
            "mean": lambda c=col: weighted_mean(c, weight, F.sum),
            "max": lambda c=col: F.max(c),
            "min": lambda c=col: F.min(c),
            "sum": lambda v=value: sum_or_zero(v * F.col(weight)),
            "std": lambda d=off, k=n: F.when(k > 1, F.sqrt(F.sum(d * d * F.col(weight)) / (k - 1))),
        }
        out += [made[stat]().alias(f"{col}_{stat}") for stat in stats]
    return out


def weighted_mean(col: str, weight: str, total: Callable[[Column], Column]) -> Column:
    """Weighted mean with the given way to total (a group or a window)."""
    value = F.col(col).cast("double")
    n = total(F.when(F.col(col).isNotNull(), F.col(weight)))
    return total(value * F.col(weight)) / n


def distinct_by_category(
    df: DataFrame,
    key: str,
    category: str,
    value: str,
    categories: Sequence[str],
    prefix: str,
    null_category: str = "UNK",
) -> DataFrame:
    """One column per category with the distinct values seen in it, 0 if none.

    Column names are ``prefix`` + lower-case category. Rows are first reduced
    to distinct (key, category, value).
    """
    facts = (
        keyed(df, key)
        .select(key, F.coalesce(category, F.lit(null_category)).alias(category), value)
        .distinct()
    )
    cells = [
        F.count(F.when(F.col(category) == c, F.col(value))).alias(prefix + c.lower())
        for c in categories
    ]
    return facts.groupBy(key).agg(*cells)


def tag_counts(df: DataFrame, key: str, tags: str, values: Sequence[str]) -> DataFrame:
    """How often each tag occurs per key; keys without any tag are absent.

    ``tags`` is an array column; a tag given twice counts twice.
    """
    counts = [F.sum(count_tag(F.col(tags), v)).alias(v) for v in values]
    return keyed(df, key).where(F.size(tags) > 0).groupBy(key).agg(*counts)


def value_frequencies(df: DataFrame, key: str, value: str, out: str = "n") -> DataFrame:
    """Distinct keys per value: the column sums of the 0/1 matrix."""
    return (
        keyed(df, key, value)
        .select(key, value)
        .distinct()
        .groupBy(value)
        .agg(F.count(F.lit(1)).alias(out))
    )


def values_per_key(df: DataFrame, key: str, value: str, out: str = "n") -> DataFrame:
    """Distinct values per key: the row sums of the 0/1 matrix."""
    return (
        keyed(df, key, value)
        .select(key, value)
        .distinct()
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias(out))
    )


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Whole row that comes first in the order, one per key.

    A ``min_by`` over structs instead of a window: no sort, combined early.
    """
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return keyed(df, key).groupBy(key).agg(first.alias("__row")).select(key, "__row.*")


def mean_by(df: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """Mean per key, as over the folds of an importance table."""
    return keyed(df, key).groupBy(key).agg(F.avg(value).alias(out or value))


def top_rows(df: DataFrame, k: int, descending: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """First k rows by the descending columns, ties by the ascending ones."""
    order = [F.col(c).desc_nulls_last() for c in descending] + [F.col(c).asc() for c in then]
    return df.orderBy(*order).limit(k)
