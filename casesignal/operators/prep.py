"""Model preparation: profile, impute, scale, encode, weight, bit features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.bounds import check_size, small_values
from casesignal.functions.bits import hashed_bits
from casesignal.functions.scalars import to_number
from casesignal.operators import order


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, non_null, varied, binary), from one pass.

    ``varied``: at least two distinct values, seen as min <> max, so nothing
    needs a distinct count. ``binary``: every value is 0 or 1 after cutting off
    its fraction; NaN, infinities and numbers beyond a long are neither.
    """

    def entry(c: str) -> Column:
        whole = F.col(c).try_cast("double").try_cast("long")
        zero_one = F.coalesce(whole.isin(0, 1), F.lit(False))
        return F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("non_null"),
            F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias("varied"),
            F.coalesce(F.bool_and(F.when(F.col(c).isNotNull(), zero_one)), F.lit(False)).alias("binary"),
        )

    packed = df.agg(F.array(*[entry(c) for c in columns]).alias("p"))
    return packed.select(F.explode("p").alias("e")).select("e.*")


def usable_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[list[str], list[str]]:
    """Drop all-null numbers and categories with fewer than two values."""
    columns = [*numeric, *categorical]
    if not columns:
        return [], []
    facts = {r["column"]: r for r in profile(df, columns).collect()}
    return (
        [c for c in numeric if facts[c]["non_null"] > 0],
        [c for c in categorical if facts[c]["varied"]],
    )


def binary_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [r["column"] for r in profile(df, columns).where("binary").collect()]


def safe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn a text column into numbers only if every value of it parses."""
    if not columns:
        return df
    row = df.agg(
        *[(F.count(c) == F.count(to_number(F.col(c)))).alias(c) for c in columns]
    ).first()
    return df.withColumns({c: to_number(F.col(c)) for c in columns if row[c]})


def medians(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """(column, median) of each column; all-null columns are absent.

    ``exact=False`` takes approximate percentiles: one pass, no shuffle of the
    values.
    """
    if exact:
        return order.exact_median(df, columns)
    packed = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.percentile_approx(F.col(c).cast("double"), 0.5).alias("median"),
                )
                for c in columns
            ]
        ).alias("p")
    )
    return packed.select(F.explode("p").alias("e")).select("e.*").where("median IS NOT NULL")


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) of the commonest value, the smallest among equals."""
    entries = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                for c in columns
            ]
        )
    )
    counts = (
        df.select(entries.alias("e"))
        .select("e.*")
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))


def as_dict(table: DataFrame) -> dict:
    """Two-column table of per-column facts as a dict (one entry per column)."""
    return {r[0]: r[1] for r in table.collect()}


def impute(df: DataFrame, values: Mapping[str, float | str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def impute_median(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the median of ``fit_on`` (the training rows)."""
    found = as_dict(medians(df if fit_on is None else fit_on, columns))
    return impute(df.withColumns({c: F.col(c).cast("double") for c in columns}), found)


def scale_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """column -> (mean, population deviation); a zero deviation becomes 1."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scaled(c: Column, stats: tuple[float, float], center: bool) -> Column:
    mean, std = stats
    return ((c - F.lit(mean)) if center else c.cast("double")) / F.lit(std)


def scale(df: DataFrame, columns: Sequence[str], center: bool = True, fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std, or x / std without centring; fitted on ``fit_on``."""
    stats = scale_stats(df if fit_on is None else fit_on, columns)
    return df.withColumns({c: scaled(F.col(c), stats[c], center) for c in columns})


def one_hot(df: DataFrame, column: str, categories: Sequence[str] | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """0/1 column ``<column>_<category>`` each; unknown and null are all zero."""
    if categories is None:
        categories = small_values(df if fit_on is None else fit_on, column)
    return df.withColumns(
        {
            f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0))
            for v in categories
        }
    )


def category_index(df: DataFrame, column: str) -> DataFrame:
    """(column, index): distinct non-null values numbered from 0 in their order.

    A stored table of any size; nothing of it passes through the driver.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("n", F.lit(1).cast("long"))
    return order.running_totals(values, column, ["n"]).select(column, F.col("n_before").cast("long").alias("index"))


def one_hot_long(df: DataFrame, column: str, index: DataFrame | None = None) -> DataFrame:
    """``df`` with ``<column>_index``, the place of its 1 in a one-hot row.

    The sparse form of ``one_hot``, for categories of any number. ``index`` is a
    table of ``category_index``, fitted on ``df`` if not given. Null and unknown
    values have a null: a row without a 1. Rows keep their number.
    """
    out, known = f"{column}_index", "__known"
    if index is None:
        index = category_index(df, column)
    found = index.select(F.col(column).alias(known), F.col("index").alias(out))
    return df.join(found, F.col(column) == F.col(known), "left").drop(known)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """(y, n, weight) with weight n_all / (classes * n)."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    packed = counts.agg(F.struct(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).alias("t"))
    total = packed.select("t").scalar()
    return counts.withColumn("weight", total["all"] / (total["k"] * F.col("n")))


def with_class_weight(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """Row weight of the balanced scheme, from one small aggregate."""
    found = {r[y]: r["weight"] for r in class_weights(df, y).collect()}
    value = F.lit(None).cast("double")
    for label, weight in found.items():
        value = F.when(F.col(y) == label, F.lit(float(weight))).otherwise(value)
    return df.withColumn(out, value)


def positive_weight(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """neg / max(pos, 1), per fold if given."""
    label = F.col(y).cast("long")
    pos, neg = F.sum(label), F.sum(1 - label)
    return df.groupBy(*by).agg((neg / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def bits_by_value(
    df: DataFrame,
    column: str,
    out: str = "bits",
    nbits: int = 1024,
    n: int = 3,
    hash_name: str = "xxhash64",
) -> DataFrame:
    """Attach the hashed bits of a column, computed once per distinct value."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    bits = check_size(values.withColumn(out, hashed_bits(F.col(column), nbits, n, hash_name))).side()
    none = F.array().cast(T.ArrayType(T.IntegerType()))
    return df.join(bits, column, "left").withColumn(out, F.coalesce(F.col(out), none))


def bits_vector(nbits: int, bits: str, out: str) -> CountVectorizerModel:
    """Transformer from a text array of bit positions to a sparse 0/1 vector."""
    model = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(nbits)], inputCol=bits, outputCol=out
    )
    return model.setBinary(True).setMinTF(0.0)
