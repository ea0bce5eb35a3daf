"""Spearman rank correlation and its p-value."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.bounds import check_size
from casesignal.operators import order
from casesignal.session import stored


def points(df: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """Complete (x, y, label) rows, as needed to draw a labelled scatter."""
    return df.select(x, y, label).dropna()


def spearman(df: DataFrame, props: Sequence[str], targets: Sequence[str], more_than: int = 3) -> DataFrame:
    """rho, t and n for each (prop, target), nulls dropped pair by pair.

    A column is ranked once for all pairs that keep all its values, and once
    more for each pair that drops some. Ranks come from the counts of each
    value. Of a pair, the side of few values (the prop, if neither) gets its
    ranks joined to the rows, which are then summed by the other side's value:
    rows are only grouped, never paired up.
    """
    pairs = [(p, t) for p in props for t in targets]
    names = list(dict.fromkeys([*props, *targets]))
    place = {c: i for i, c in enumerate(names)}
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])

    def both(p: str, t: str) -> Column:
        return F.col(f"v{place[p]}").isNotNull() & F.col(f"v{place[t]}").isNotNull()

    found = rows.agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in place.values()], *[F.count_if(both(*pair)).alias(f"p{i}") for i, pair in enumerate(pairs)]
    ).first()
    # A column, and the one whose nulls it drops, if it has values there.
    ranked: dict[tuple[str, str | None], int] = {}
    sides = []
    for i, (p, t) in enumerate(pairs):
        keys = [(c, None if found[f"p{i}"] == found[f"n{place[c]}"] else o) for c, o in ((p, t), (t, p))]
        sides.append([ranked.setdefault(key, len(ranked)) for key in keys])

    def value(key: tuple[str, str | None]) -> Column:
        own = F.col(f"v{place[key[0]]}")
        return own if key[1] is None else F.when(both(*key), own)

    columns = list(ranked)
    entries = F.array(*[F.struct(F.lit(i).alias("side"), value(key).alias("value")) for i, key in enumerate(columns)])
    long = rows.select(F.explode(entries).alias("e")).select("e.*").where("value IS NOT NULL")
    counts = long.groupBy("side", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = order.running_totals(counts, "value", ["n"], ["side"])
    # The mean rank is (n + 1) / 2 with or without ties.
    off = F.col("n_before") + F.col("n") / 2 - F.col("n_total") / 2
    ranks = stored(totals.select("side", "value", "n", "n_total", off.alias("off")), "ranks")

    few = {}
    for i in range(len(columns)):
        few[i] = check_size(ranks.where(F.col("side") == i).select(F.col("value").alias(f"x{i}"), F.col("off").alias(f"d{i}")))
    chosen = [(x, y) if few[x].small or not few[y].small else (y, x) for x, y in sides]
    for i in sorted({x for x, _ in chosen}):
        rows = rows.join(few[i].side(), value(columns[i]) == F.col(f"x{i}"), "left").drop(f"x{i}")
    to = sorted({y for _, y in chosen})
    joined = sorted({x for x, _ in chosen})
    grouped = F.array(*[F.struct(F.lit(i).alias("side"), value(columns[i]).alias("value")) for i in to])
    long = rows.select(F.explode(grouped).alias("e"), *[f"d{i}" for i in joined]).select("e.*", *[f"d{i}" for i in joined])
    sums = long.where("value IS NOT NULL").groupBy("side", "value").agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in joined])
    products = F.array(*[F.struct(F.lit(i).alias("x"), F.sum(F.col("off") * F.col(f"d{i}")).alias("sxy")) for i in joined])
    crossed = sums.join(ranks, ["side", "value"]).groupBy(F.col("side").alias("y")).agg(products.alias("p"))
    crossed = crossed.select("y", F.explode("p").alias("p")).select("y", "p.*")
    spread = ranks.groupBy("side").agg(F.max("n_total").alias("n"), F.sum(F.col("n") * F.col("off") * F.col("off")).alias("s"))
    listed = df.sparkSession.createDataFrame([(*pair, *own) for pair, own in zip(pairs, chosen, strict=True)], "prop string, target string, x int, y int")
    sums = (
        listed.join(crossed, ["x", "y"])
        .join(spread.select(F.col("side").alias("x"), "n", F.col("s").alias("sxx")), "x")
        .join(spread.select(F.col("side").alias("y"), F.col("s").alias("syy")), "y")
    )
    rho = F.col("sxy") / F.nullif(F.sqrt(F.col("sxx") * F.col("syy")), F.lit(0.0))
    out = sums.where(F.col("n") > more_than).select("prop", "target", "n", rho.alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0)))
    return out.withColumn("t", t)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 2000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(rho: float, n: int) -> float:
    """P(|t| >= observed) with n - 2 degrees of freedom."""
    if rho is None or np.isnan(rho) or n <= 2:
        return float("nan")
    return _beta_share((n - 2) / 2.0, 0.5, max(0.0, 1.0 - rho * rho))


@F.pandas_udf(T.DoubleType())
def _p_values(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for rho, n in batches:
        yield pd.Series([two_sided_p(r, k) for r, k in zip(rho, n)], dtype="float64")


def with_p_value(correlations: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Add ``p_value``; runs on the few aggregate rows only."""
    p = _p_values(F.col(rho), F.col(n))
    return correlations.withColumn("p_value", F.when(~F.isnan(p), p))
