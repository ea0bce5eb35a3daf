"""Outcome labels: counts, thresholds, top-K labels and the 0/1 matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casesignal.operators import aggregate, relate


def outcome_counts(outcomes: DataFrame, case_id: str, out: str = "ADR_count") -> DataFrame:
    """Outcome rows per case."""
    return aggregate.rows_per(outcomes, case_id, out)


def with_multi_label(
    cases: DataFrame,
    counts: DataFrame,
    case_id: str,
    count: str = "ADR_count",
    label: str = "y_multiADR",
    at_least: int = 2,
) -> DataFrame:
    """Attach the outcome count (0 if none) and the label count >= 2."""
    joined = relate.attach(cases, counts, case_id)
    filled = F.coalesce(F.col(count), F.lit(0)).cast("long")
    return joined.withColumn(count, filled).withColumn(
        label, (F.col(count) >= at_least).cast("int")
    )


def top_labels(pairs: DataFrame, case_id: str, label: str, k: int) -> DataFrame:
    """(label, n): the k labels with most cases, ties by label."""
    counted = aggregate.value_frequencies(pairs, case_id, label)
    return aggregate.top_rows(counted, k, ["n"], [label])


def label_names(pairs: DataFrame, case_id: str, label: str, k: int) -> list[str]:
    """The k names as a list, to make columns of."""
    return [r[0] for r in top_labels(pairs, case_id, label, k).collect()]


def label_matrix(
    pairs: DataFrame, case_id: str, label: str, names: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """One 0/1 column per name; cases with none of the names keep a row of 0."""
    cells: list[Column] = [
        F.max((F.col(label) == n).cast("int")).alias(c) for n, c in zip(names, columns or names)
    ]
    return aggregate.keyed(pairs, case_id, label).groupBy(case_id).agg(*cells)


def long_labels(pairs: DataFrame, case_id: str, label: str) -> DataFrame:
    """The matrix in long form: its ones, as distinct (case, label)."""
    return aggregate.keyed(pairs, case_id, label).select(case_id, label).distinct()


def multi_vs_single(pairs: DataFrame, case_id: str, label: str, k: int, out: str = "y") -> DataFrame:
    """1 for cases with two or more top-k labels, 0 for exactly one, others out."""
    top = F.broadcast(top_labels(pairs, case_id, label, k).select(label))
    kept = relate.restrict_to(pairs, top, label)
    n = aggregate.values_per_key(kept, case_id, label, "n_labels")
    return n.withColumn(out, (F.col("n_labels") >= 2).cast("int"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Positives, negatives and the share of positives, as one row."""
    y = F.col(label).cast("long")
    return df.where(y.isNotNull()).agg(
        aggregate.sum_or_zero(y).alias("pos"),
        aggregate.sum_or_zero(1 - y).alias("neg"),
        F.avg(y).alias("pos_share"),
    )


def align_xy(x: DataFrame, picked: DataFrame, y_keys: DataFrame, case_id: str, name: str, picked_name: str, order: Sequence[str]) -> DataFrame:
    """One feature row per labelled case: that of its picked exposure."""
    chosen = picked.withColumnRenamed(picked_name, name)
    rows = relate.restrict_to(x, chosen, [case_id, name])
    rows = relate.restrict_to(rows, y_keys.select(case_id).distinct(), case_id)
    return aggregate.first_per_key(rows, case_id, order)
