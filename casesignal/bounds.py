"""Size checks: what may be broadcast or written into an expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

INLINE_ROWS = 256
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 8 << 20
# Rows fetched first; their width tells what the rest would take.
_HEAD = 1_000


@dataclass(frozen=True)
class Dimension:
    """A lookup table whose row count was checked once.

    ``rows`` is None when the table is over the limit; then ``side`` leaves the
    join strategy to the optimizer, so a large dimension is shuffled.
    """

    df: DataFrame
    rows: tuple[Row, ...] | None

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def small(self) -> bool:
        return self.rows is not None

    def side(self) -> DataFrame:
        return F.broadcast(self.df) if self.small else self.df

    def select(self, *cols: str | Column) -> Dimension:
        """Project; a checked size stays checked."""
        picked = self.df.select(*cols)
        if not self.small:
            return Dimension(picked, None)
        return check_size(picked, limit=len(self.rows or ()))


def check_size(df: DataFrame | Dimension, limit: int = BROADCAST_ROWS) -> Dimension:
    """Fetch the table if it has at most ``limit`` rows and BROADCAST_BYTES.

    A table that fits is held as a local relation, so later joins neither
    recompute it nor guess its size. The first rows are fetched alone: if rows
    are so wide that the rest could exceed the bytes, no more is fetched.
    """
    if isinstance(df, Dimension):
        return df
    head = df.limit(min(limit, _HEAD) + 1).toArrow()
    if head.num_rows > _HEAD and limit > _HEAD:
        if head.nbytes / head.num_rows * limit > BROADCAST_BYTES:
            return Dimension(df, None)
        head = df.limit(limit + 1).toArrow()
    if head.num_rows > limit or head.nbytes > BROADCAST_BYTES:
        return Dimension(df, None)
    pinned = df.sparkSession.createDataFrame(head, schema=df.schema)
    return Dimension(pinned, tuple(Row(**r) for r in head.to_pylist()))


def few_values(df: DataFrame, column: str, limit: int) -> list | None:
    """Sorted distinct non-null values, or None if there are more than ``limit``."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else sorted(r[0] for r in rows)


def small_values(df: DataFrame, column: str, limit: int = 10_000) -> list:
    """Sorted distinct non-null values; raises beyond the limit, never cuts."""
    values = few_values(df, column, limit)
    if values is None:
        raise ValueError(f"{column} has more than {limit} values; keep the long form")
    return values
