"""Name resolution: standard names, trade names, the four-step cascade."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.bounds import INLINE_ROWS, Dimension, check_size
from casesignal.functions import text
from casesignal.functions.vocab import BRAND_TO_GENERIC, SYNONYMS
from casesignal.sources.contract import resolve_column


# Place of a null ordinal.
_FIRST = -(1 << 63)


def add_std_name(
    df: DataFrame,
    candidates: Sequence[str],
    out: str = "NAME_STD",
    null_token: str | None = None,
) -> tuple[DataFrame, str | None]:
    """Standard name of the first candidate column present, and which it was.

    Without any candidate the new column is null.
    """
    used = resolve_column(df, candidates)
    value = F.lit(None).cast("string") if used is None else text.std_name(F.col(used), null_token)
    return df.withColumn(out, value), used


def _literal_map(mapping: Mapping[str, str]) -> Column:
    if not mapping:
        return F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def map_brand(
    df: DataFrame,
    name: str,
    out: str,
    mapping: Mapping[str, str] | DataFrame | Dimension = BRAND_TO_GENERIC,
) -> DataFrame:
    """Replace mapped names, keep all others.

    A small dictionary becomes an expression (no join); a table with columns
    ``key`` and ``value``, unique by key, becomes a left join.
    """
    if isinstance(mapping, Mapping) and len(mapping) <= INLINE_ROWS:
        return df.withColumn(
            out, F.coalesce(F.try_element_at(_literal_map(mapping), F.col(name)), F.col(name))
        )
    if isinstance(mapping, Mapping):
        mapping = df.sparkSession.createDataFrame(list(mapping.items()), "key string, value string")
    table = check_size(mapping).side().select(
        F.col("key").alias("__key"), F.col("value").alias("__value")
    )
    joined = df.join(table, F.col(name) == F.col("__key"), "left")
    return joined.withColumn(out, F.coalesce("__value", name)).drop("__key", "__value")


def resolve_names(
    df: DataFrame,
    name: str,
    dim: DataFrame | Dimension,
    dim_name: str = "drug_name",
    ordinal: str | None = None,
    synonyms: Mapping[str, str] = SYNONYMS,
    out: str = "drug_mapped",
    keep_unmatched: bool = True,
    inline_rows: int = INLINE_ROWS,
) -> DataFrame:
    """Map free text to a dimension name; null where nothing fits.

    Steps, first hit wins: the whole key, its first token, the first token in
    the synonyms, the first dimension key (by ``ordinal``, else by name) that
    the text contains.

    A dimension of at most ``inline_rows`` rows becomes one expression over
    each row: no shuffle and no join. A larger one is matched on the distinct
    names by a single equi-join on whole key, token and substrings.

    Null and empty dimension names are no names; a null ordinal comes first,
    equal ordinals go by name.

    ``keep_unmatched=False`` drops rows without a match right here. A filter
    set on the result instead would be pushed below the expression, which then
    runs twice.
    """
    checked = check_size(dim)
    if checked.small and len(checked.rows) <= inline_rows:
        rows = [r for r in checked.rows if r[dim_name]]
        place = (lambda r: _FIRST if r[ordinal] is None else int(r[ordinal])) if ordinal else lambda r: 0
        rows = sorted(rows, key=lambda r: (place(r), r[dim_name].upper(), r[dim_name]))
        keys = {r[dim_name].upper(): r[dim_name] for r in rows}
        return _resolve_by_expression(df, name, keys, synonyms, out, keep_unmatched)
    mapped = _resolve_by_join(df, name, checked, dim_name, ordinal, synonyms, out)
    return mapped if keep_unmatched else mapped.where(F.col(out).isNotNull())


def _resolve_by_expression(
    df: DataFrame,
    name: str,
    keys: Mapping[str, str],
    synonyms: Mapping[str, str],
    out: str,
    keep_unmatched: bool,
) -> DataFrame:
    # Key, token and result are steps of their own: each is used several times
    # and must not be worked out again for every use.
    key, token = F.col("__key"), F.col("__token")
    known = _literal_map(keys)
    inside = [F.when(key.contains(k), F.lit(v)) for k, v in keys.items() if k]
    found = (
        df.withColumn("__key", text.lookup_key(F.col(name)))
        .withColumn("__token", text.first_token(key))
        .withColumn(
            "__found",
            F.coalesce(
                F.try_element_at(known, key),
                F.try_element_at(known, token),
                F.try_element_at(_literal_map(synonyms), token),
                *inside,
            ),
        )
    )
    if keep_unmatched:
        return found.select(*df.columns, F.col("__found").alias(out))
    hit = F.when(F.col("__found").isNotNull(), F.array("__found"))
    return found.select(*df.columns, F.explode(hit).alias(out))


def _resolve_by_join(
    df: DataFrame,
    name: str,
    dim: Dimension,
    dim_name: str,
    ordinal: str | None,
    synonyms: Mapping[str, str],
    out: str,
) -> DataFrame:
    spark = df.sparkSession
    base = dim.df.where(F.col(dim_name).isNotNull() & (F.col(dim_name) != ""))
    order = F.coalesce(F.col(ordinal).cast("long"), F.lit(_FIRST)) if ordinal else F.lit(0).cast("long")
    vocab = (
        base.groupBy(F.upper(dim_name).alias("__cand"))
        .agg(
            F.min(order).alias("__ord"),
            F.max_by(dim_name, F.struct(order, F.col(dim_name))).alias("__value"),
        )
        .withColumn("__kind", F.lit("dim"))
    )
    syn = spark.createDataFrame(
        [(k, 0, v, "syn") for k, v in synonyms.items()],
        "__cand string, __ord long, __value string, __kind string",
    )
    vocab = vocab.unionByName(syn)

    # A key can only sit in the text at one of the key lengths; the list of
    # lengths is at most as long as the longest key.
    lengths = base.agg(F.sort_array(F.collect_set(F.length(F.upper(dim_name))))).scalar()
    distinct = (
        df.select(F.col(name).alias("__raw"))
        .where(F.col("__raw").isNotNull())
        .distinct()
        .withColumn("__text", text.lookup_key(F.col("__raw")))
        .withColumn("__token", text.first_token(F.col("__text")))
        .withColumn("__lengths", lengths)
    )
    pieces = F.array_distinct(
        F.flatten(
            F.transform(
                F.filter("__lengths", lambda n: n <= F.length("__text")),
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.length("__text") - n + 1),
                    lambda i: F.substring(F.col("__text"), i, n),
                ),
            )
        )
    )
    tries = F.concat(
        F.array(
            F.struct(F.lit(1).alias("step"), F.lit("dim").alias("kind"), F.col("__text").alias("cand")),
            F.struct(F.lit(2).alias("step"), F.lit("dim").alias("kind"), F.col("__token").alias("cand")),
            F.struct(F.lit(3).alias("step"), F.lit("syn").alias("kind"), F.col("__token").alias("cand")),
        ),
        F.transform(
            pieces,
            lambda p: F.struct(F.lit(4).alias("step"), F.lit("dim").alias("kind"), p.alias("cand")),
        ),
    )
    hits = (
        distinct.select("__raw", F.explode(tries).alias("t"))
        .select("__raw", "t.step", F.col("t.kind").alias("__kind"), F.col("t.cand").alias("__cand"))
        .join(vocab, ["__kind", "__cand"])
        .groupBy("__raw")
        .agg(F.min_by("__value", F.struct("step", "__ord", "__cand")).alias(out))
    )
    return df.join(hits, df[name] == hits["__raw"], "left").drop("__raw")
