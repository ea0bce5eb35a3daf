"""Reproducible splits. Rows are placed by the md5 of their id and the seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casesignal.bounds import check_size
from casesignal.functions.scalars import hash_fraction, hash_text
from casesignal.operators import order


def holdout(df: DataFrame, id_col: str, seed: int | str, share: float = 0.2, out: str = "is_test") -> DataFrame:
    """Plain split by the hash of the id: a narrow expression, no shuffle."""
    return df.withColumn(out, (hash_fraction(id_col, F.lit(seed)) < share).cast("int"))


def _cuts_passed(df: DataFrame, id_col: str, strata: Sequence[str], seed: int | str, shares: Sequence[float], out: str) -> DataFrame:
    """Number of the stratum's cut positions that lie before each row.

    Only the hashes at the cuts are computed; the rows themselves are compared
    with them in place and never shuffled.
    """
    if not strata:
        raise ValueError("name at least one stratum column, or use holdout")
    hashed = df.withColumn("__h", hash_text(id_col, F.lit(seed)))
    cuts = order.hash_cuts(hashed, strata, "__h", id_col, shares)
    cuts = cuts.select(*[F.col(c).alias(f"__s_{c}") for c in strata], F.col("cuts").alias("__cuts"))
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    here = F.struct(F.col("__h").alias("h"), F.col(id_col).alias("i"))
    passed = F.size(F.filter("__cuts", lambda cut: cut < here))
    return hashed.join(check_size(cuts).side(), same, "left").select(*df.columns, passed.alias(out))


def stratified_holdout(
    df: DataFrame,
    id_col: str,
    strata: Sequence[str],
    seed: int | str,
    share: float = 0.2,
    out: str = "is_test",
) -> DataFrame:
    """Exactly ceil(share * n) test rows in each stratum."""
    passed = _cuts_passed(df, id_col, strata, seed, [share], out)
    return passed.withColumn(out, 1 - F.col(out))


def stratified_folds(
    df: DataFrame,
    id_col: str,
    strata: Sequence[str],
    seed: int | str,
    folds: int = 5,
    out: str = "fold",
) -> DataFrame:
    """Fold 0 .. folds-1: equal stretches of the hash order in each stratum."""
    return _cuts_passed(df, id_col, strata, seed, [i / folds for i in range(1, folds)], out)


def nested(df: DataFrame, id_col: str, seed: int | str, strata: Sequence[str] = (), share: float = 0.2) -> DataFrame:
    """Column ``part``: test, then val out of the rest, else train."""
    split = stratified_holdout if strata else holdout
    args = (strata,) if strata else ()
    outer = split(df, id_col, *args, f"{seed}", share, "__test")
    rest = outer.where("__test = 0").drop("__test")
    inner = split(rest, id_col, *args, f"{seed}-val", share, "__val")
    test = outer.where("__test = 1").drop("__test").withColumn("part", F.lit("test"))
    named = F.when(F.col("__val") == 1, F.lit("val")).otherwise(F.lit("train"))
    return test.unionByName(inner.withColumn("part", named).drop("__val"))
