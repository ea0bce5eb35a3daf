"""Exact ranks, running totals and order statistics without a one-task window.

A window without a (fine) partition key sends all rows to one task. Here the
rows are sorted into ranges: each range is summed on its own, and the few range
totals give every range its offset. Every size takes the same path, and nothing
but Spark's own bounded sample of range borders reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.bounds import check_size
from casesignal.session import stored


def _before(*by: str | Column):
    return Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def _same(a: Sequence[object], b: Sequence[object]) -> bool:
    """Equal keys; NaN equals NaN and null equals null."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def _group_starts(batch: pa.RecordBatch, by: Sequence[str], held: list[object] | None) -> np.ndarray:
    """True at each row whose group differs from the row before; ``held`` is the last group so far."""
    starts = np.zeros(batch.num_rows, dtype=bool)
    starts[0] = held is None or not _same(held, [batch.column(c)[0].as_py() for c in by])
    for c in by:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts[1:] |= codes[1:] != codes[:-1]
    return starts


def _running(value: str, sums: Sequence[str], by: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to sorted batches the range's number, the sums before each row and
    the value before it, all within its group and range. A task holds a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        held, carried, last = None, dict.fromkeys(sums, 0), None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            starts = _group_starts(batch, by, held)
            first = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            added = [pa.array(np.full(n, place, dtype=np.int32))]
            for s in sums:
                column = batch.column(s)
                own = column.cast(pa.int64() if pa.types.is_integer(column.type) else pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
                up = np.cumsum(own)
                # What came before the group began; a group held over adds to what is carried.
                out = up - own - np.where(first >= 0, (up - own)[first], -carried[s])
                added.append(pa.array(out))
                carried[s] = (out[-1] + own[-1]).item()
            values = batch.column(value)
            shifted = pa.concat_arrays([pa.array([last], type=values.type), values.slice(0, n - 1)])
            added.append(pc.if_else(pa.array(starts), pa.scalar(None, type=values.type), shifted))
            held, last = [batch.column(c)[n - 1].as_py() for c in by], values[n - 1].as_py()
            names = [*batch.schema.names, "__at", *[f"__in_{s}" for s in sums], "__in_top"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return run


def running_totals(
    table: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    previous: str | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Add ``<s>_before`` (sum over smaller values) and ``<s>_total`` per group.

    ``table`` has one row per (group, value). With ``previous``, a column of
    that name holds the next smaller value of the group. A null in ``by`` is a
    group like any other. A null value comes before all others, NaN after.

    Rows are sorted into ranges of (group, value), so a group may span ranges.
    Each range is summed as it streams by and written once; its totals, a row
    for each group in it, give the offsets. There are as many ranges as shuffle
    partitions, or one for every ``bucket_rows`` rows.
    """
    by, keys = list(by), [*by, value]
    spark = table.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if bucket_rows is not None:
        table = stored(table, "values")
        ranges = max(1, -(-table.count() // bucket_rows))
    fields = list(table.schema.fields)
    whole = [isinstance(table.schema[s].dataType, T.IntegralType) for s in sums]
    fields.append(T.StructField("__at", T.IntegerType()))
    fields += [T.StructField(f"__in_{s}", T.LongType() if w else T.DoubleType()) for s, w in zip(sums, whole, strict=True)]
    fields.append(T.StructField("__in_top", table.schema[value].dataType))
    placed = table.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    local = stored(placed.mapInArrow(_running(value, list(sums), by), T.StructType(fields)), "running")

    totals = local.groupBy(*by, "__at").agg(*[F.sum(s).alias(s) for s in sums], F.max(value).alias("__top"))
    earlier, group = _before(*by).orderBy("__at"), Window.partitionBy(*by)
    offsets = totals.select(
        *[F.col(c).alias(f"__g_{c}") for c in by],
        F.col("__at").alias("__range"),
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"__off_{s}") for s in sums],
        *[F.sum(s).over(group).alias(f"{s}_total") for s in sums],
        F.max("__top").over(earlier).alias("__off_top"),
    )
    same = F.col("__at") == F.col("__range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    extra = [] if previous is None else [F.coalesce("__in_top", "__off_top").alias(previous)]
    return local.join(offsets, same).select(
        *table.columns,
        *[(F.col(f"__off_{s}") + F.col(f"__in_{s}")).alias(f"{s}_before") for s in sums],
        *[F.col(f"{s}_total") for s in sums],
        *extra,
    )


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(group, value, rank): rank from 1, ties share their mean rank."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    table = df.groupBy(*by, value).agg(n.alias("n"))
    ranked = running_totals(table, value, ["n"], by)
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    return ranked.select(*by, value, rank.alias("rank"), F.col("n_total"))


def hash_cuts(
    df: DataFrame, by: Sequence[str], hashed: str, then: str, shares: Sequence[float], prefix: int = 4
) -> DataFrame:
    """Per group the (hash, id) at each position ceil(share * n), as an array.

    Rows are taken in the order of a hex hash, ties by ``then``. Counts by hash
    part (the first hex digits) find the parts that hold the positions; only
    their rows are ranked, about one in 16^prefix per position. So a group may
    be as large as the table, and no other row is moved.
    """
    by = list(by)
    placed = df.select(*by, hashed, then).withColumn("__part", F.substring(hashed, 1, prefix))
    sizes = placed.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(*by))
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.ceil(total * F.lit(float(s))).alias("at"))
            for i, s in enumerate(shares)
        ]
    )
    located = (
        sizes.select(
            *by,
            "__part",
            "__n",
            F.coalesce(F.sum("__n").over(_before(*by).orderBy("__part")), F.lit(0)).alias("__off"),
            wanted.alias("__wanted"),
        )
        .select(*by, "__part", "__n", "__off", F.explode("__wanted").alias("__want"))
        .where("__off < __want.at AND __want.at <= __off + __n")
        .select(
            *[F.col(c).alias(f"__g_{c}") for c in by],
            F.col("__part").alias("__at"),
            F.col("__want.i").alias("__i"),
            (F.col("__want.at") - F.col("__off")).alias("__pick"),
        )
    )
    # One row per group and position.
    located = check_size(located).side()
    same = F.col("__part") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    inside = Window.partitionBy(*by, "__i").orderBy(hashed, then)
    cut = F.struct(F.col(hashed).alias("h"), F.col(then).alias("i"))
    return (
        placed.join(located, same)
        .withColumn("__rn", F.row_number().over(inside))
        .where("__rn = __pick")
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(cut)).alias("cuts"))
    )


def exact_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, median) with the mean of the middle two for even counts.

    Values are counted first; the middle is found in the running counts.
    """
    entries = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                for c in columns
            ]
        )
    )
    long = df.select(entries.alias("e")).select("e.*").where("value IS NOT NULL")
    table = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(table, "value", ["n"], ["column"])
    low, high = F.floor((F.col("n_total") - 1) / 2), F.floor(F.col("n_total") / 2)

    def holds(position: Column) -> Column:
        return (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))

    return ranked.groupBy("column").agg(
        (
            (F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2
        ).alias("median")
    )
