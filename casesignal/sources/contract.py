"""Input contracts, checked on the schema before any job runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MissingColumns(ValueError):
    """A table lacks columns that an operator needs."""


def require_columns(df: DataFrame, columns: Sequence[str], table: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{table} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def resolve_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate that the table has, else None."""
    return next((c for c in candidates if c in df.columns), None)


def with_first_names(df: DataFrame, choices: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each name of ``choices`` taken from the first of its candidates that the table has.

    The chosen column gets the name, in place of a column that had it before.
    A name without a candidate in the table is left as it is. All choices are
    made on the table's own columns, so their order does not matter.
    """
    found = {name: resolve_column(df, candidates) for name, candidates in choices.items()}
    taken = {c: name for name, c in found.items() if c is not None}
    # Columns that resolve like a chosen name would make it ambiguous.
    hidden = {name.lower() for name in taken.values()}
    return df.select(
        *[
            F.col(f"`{c}`").alias(taken[c]) if c in taken else F.col(f"`{c}`")
            for c in df.columns
            if c in taken or c.lower() not in hidden
        ]
    )


def ensure_columns(df: DataFrame, columns: Mapping[str, str | T.DataType]) -> DataFrame:
    """Add each missing column as a null of the given type."""
    new = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(new) if new else df


def fill_nulls(df: DataFrame, values: Mapping[str, int | float | str]) -> DataFrame:
    """Fill nulls by column; integer fills also make the column a long."""
    present = {c: v for c, v in values.items() if c in df.columns}
    new = {}
    for c, v in present.items():
        filled = F.coalesce(F.col(c), F.lit(v))
        new[c] = filled.cast("long") if isinstance(v, int) else filled
    return df.withColumns(new) if new else df
