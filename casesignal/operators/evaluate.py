"""Exact evaluation of scored rows.

Input is a long table with a 0/1 label, a score and any grouping columns
(label name, fold). It is reduced to one row per distinct score before
anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casesignal.bounds import check_size
from casesignal.operators.order import running_totals

# The 19 thresholds 0.05, 0.10, ..., 0.95.
THRESHOLD_GRID = tuple(float(t) for t in np.linspace(0.05, 0.95, 19))


def score_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """pos and neg per distinct score, the counts below it and in all, and the
    next smaller score."""
    label = F.col(y).cast("long")
    counts = (
        df.where(F.col(score).isNotNull() & label.isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.sum(label).alias("pos"), F.sum(1 - label).alias("neg"))
    )
    return running_totals(counts, "score", ["pos", "neg"], by, previous="below")


def _hits() -> tuple[Column, Column]:
    """True and false positives when every row from this score up is taken."""
    return F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")


def _auc() -> Column:
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    return F.sum(won) / _nz(F.max("pos_total").cast("double") * F.max("neg_total"))


def _ap() -> Column:
    tp, fp = _hits()
    return F.sum(F.col("pos") * (tp / (tp + fp))) / _nz(F.max("pos_total"))


def _f1() -> Column:
    """F1 at a threshold, from whole counts: equal values compare as equal."""
    tp, fp = _hits()
    return 2 * tp / (F.col("pos_total") + tp + fp)


def _lowest_best() -> Column:
    return F.struct(_f1(), -F.col("score"))


def _nz(c: Column) -> Column:
    return F.nullif(c.cast("double"), F.lit(0.0))


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties count one half; null with one class only."""
    return score_counts(df, y, score, by).groupBy(*by).agg(_auc().alias("auc"))


def average_precision(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision, no interpolation."""
    return score_counts(df, y, score, by).groupBy(*by).agg(_ap().alias("ap"))


def auc_and_ap(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Both areas from one score table."""
    table = score_counts(df, y, score, by)
    return table.groupBy(*by).agg(_auc().alias("auc"), _ap().alias("ap"))


def pr_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each threshold, and the end point (1, 0)."""
    table = score_counts(df, y, score, by)
    tp, fp = _hits()
    curve = table.select(
        *by,
        F.col("score").alias("threshold"),
        (tp / (tp + fp)).alias("precision"),
        (tp / _nz(F.col("pos_total"))).alias("recall"),
    )
    ends = table.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return curve.unionByName(ends)


def best_threshold(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the highest F1; the lowest one among equals."""
    return score_counts(df, y, score, by).groupBy(*by).agg(
        F.max_by("score", _lowest_best()).alias("threshold"), F.max(_f1()).alias("f1")
    )


def stepped_threshold(
    df: DataFrame,
    y: str,
    score: str,
    by: Sequence[str] = (),
    low: float = 0.01,
    high: float = 0.99,
    default: float = 0.5,
) -> DataFrame:
    """The score one step below the F1-optimal one, clipped to [low, high].

    That step is part of the defined result. The default stands where the
    optimum is the lowest score, and where a group has one class only. The
    binary form is ``low=0.3``.
    """
    best = score_counts(df, y, score, by).groupBy(*by).agg(
        F.max_by(F.struct("below"), _lowest_best())["below"].alias("below"),
        F.max("pos_total").alias("n_pos"),
        F.max("neg_total").alias("n_neg"),
    )
    stepped = F.when(
        F.col("below").isNotNull(), F.greatest(F.least(F.col("below"), F.lit(high)), F.lit(low))
    )
    chosen = F.when(
        (F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.coalesce(stepped, F.lit(default))
    ).otherwise(F.lit(default))
    return best.select(*by, chosen.cast("double").alias("threshold"))


def grid_threshold(
    df: DataFrame, y: str, score: str, by: Sequence[str] = (), grid: Sequence[float] = THRESHOLD_GRID
) -> DataFrame:
    """Best F1 over a fixed grid, first of equals.

    Each row counts once, at the number of grid points it reaches; sums over
    these few cells give the counts at every point.
    """
    points = sorted(float(t) for t in grid)
    label = F.col(y).cast("long")
    reached = sum(((F.col(score) >= t).cast("int") for t in points), F.lit(0))
    cells = (
        df.where(F.col(score).isNotNull() & label.isNotNull())
        .groupBy(*by, reached.alias("reached"))
        .agg(F.sum(label).alias("pos"), F.sum(1 - label).alias("neg"))
    )
    sums = []
    for i in range(len(points)):
        over = F.col("reached") > i
        sums += [
            F.sum(F.when(over, F.col("pos")).otherwise(0)).alias(f"tp{i}"),
            F.sum(F.when(over, F.col("neg")).otherwise(0)).alias(f"fp{i}"),
        ]
    wide = cells.groupBy(*by).agg(F.sum("pos").alias("p"), *sums)
    tries = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("threshold"),
                    F.coalesce(
                        2 * F.col(f"tp{i}") / _nz(F.col("p") + F.col(f"tp{i}") + F.col(f"fp{i}")),
                        F.lit(0.0),
                    ).alias("f1"),
                )
                for i, t in enumerate(points)
            ]
        )
    )
    return (
        wide.select(*by, tries.alias("t"))
        .groupBy(*by)
        .agg(
            F.max_by("t.threshold", F.struct("t.f1", -F.col("t.threshold"))).alias("threshold"),
            F.max("t.f1").alias("f1"),
        )
    )


def apply_threshold(
    df: DataFrame, score: str, threshold: float | DataFrame, by: Sequence[str] = (), out: str = "pred",
    default: float = 0.5,
) -> DataFrame:
    """1 where the score reaches the threshold (one for all, or one per group).

    A group without a threshold takes ``default``. A null in ``by`` is a group
    like any other.
    """
    if not isinstance(threshold, DataFrame):
        return df.withColumn(out, (F.col(score) >= F.lit(float(threshold))).cast("int"))
    if not by:
        limit = F.coalesce(threshold.select("threshold").scalar(), F.lit(default))
        return df.withColumn(out, (F.col(score) >= limit).cast("int"))
    table = threshold.select(*[F.col(c).alias(f"__g_{c}") for c in by], F.col("threshold").alias("__threshold"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in by])
    joined = df.join(check_size(table).side(), same, "left")
    limit = F.coalesce("__threshold", F.lit(default))
    return joined.select(*df.columns, (F.col(score) >= limit).cast("int").alias(out))


def _cell(y: str, pred: str, yv: int, pv: int) -> Column:
    hit = (F.col(y) == yv) & (F.col(pred) == pv)
    return F.coalesce(F.sum(hit.cast("long")), F.lit(0))


def confusion(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp; all four cells are present."""
    return df.groupBy(*by).agg(
        _cell(y, pred, 0, 0).alias("tn"),
        _cell(y, pred, 0, 1).alias("fp"),
        _cell(y, pred, 1, 0).alias("fn"),
        _cell(y, pred, 1, 1).alias("tp"),
    )


def _or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(num.cast("double") / _nz(den), F.lit(0.0))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return _or_zero(tp, tp + fp), _or_zero(tp, tp + fn), _or_zero(2 * tp, 2 * tp + fp + fn)


def binary_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of class 1; 0 where the denominator is 0."""
    return from_confusion(confusion(df, y, pred, by), by)


def from_confusion(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return cells.select(*by, p.alias("precision"), r.alias("recall"), f.alias("f1"))


def classification_report(cells: DataFrame) -> DataFrame:
    """Report rows (class 0, class 1, accuracy, macro and weighted average).

    ``cells`` is the one-row result of :func:`confusion`.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zero, one = _prf(tn, fn, fp), _prf(tp, fp, fn)
    n0, n1 = tn + fp, fn + tp
    n = n0 + n1
    accuracy = _or_zero(tn + tp, n)

    def row(name: str, prf: Sequence[Column], support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            prf[0].alias("precision"),
            prf[1].alias("recall"),
            prf[2].alias("f1"),
            support.cast("long").alias("support"),
        )

    macro = [(a + b) / 2 for a, b in zip(zero, one)]
    weighted = [_or_zero(a * n0 + b * n1, n) for a, b in zip(zero, one)]
    rows = F.array(
        row("0", zero, n0),
        row("1", one, n1),
        row("accuracy", [accuracy] * 3, n),
        row("macro avg", macro, n),
        row("weighted avg", weighted, n),
    )
    return cells.select(F.explode(rows).alias("r")).select("r.*")


def micro_macro_f1(df: DataFrame, y: str, pred: str, label: str) -> DataFrame:
    """F1 of the pooled counts, and the mean F1 of the labels."""
    per = confusion(df, y, pred, [label])
    _, _, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    _, _, pooled = _prf(F.sum("tp"), F.sum("fp"), F.sum("fn"))
    return per.agg(pooled.alias("micro_f1"), F.avg(f1).alias("macro_f1"))


def micro_macro_auc(df: DataFrame, y: str, score: str, label: str) -> DataFrame:
    """AUC of all rows pooled, and the mean AUC of the labels.

    The mean is null if a label has one class only, as it is undefined then.
    The pooled counts are sums of the labels' counts: the rows are read once.
    """
    table = score_counts(df, y, score, [label])
    per = table.groupBy(label).agg(_auc().alias("auc"))
    mean = per.agg(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("macro_auc"))
    pooled = table.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pooled = running_totals(pooled, "score", ["pos", "neg"]).agg(_auc().alias("auc")).scalar()
    return mean.select(pooled.alias("micro_auc"), "macro_auc")


def mean_auc(df: DataFrame, y: str, score: str, label: str) -> DataFrame:
    """Mean AUC over the labels that have both classes."""
    per = roc_auc(df, y, score, [label])
    return per.agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("n_labels"))


def fold_metrics(df: DataFrame, y: str, score: str, fold: str) -> DataFrame:
    """AUC, average precision, best F1 and its threshold per fold, from one score table."""
    return score_counts(df, y, score, [fold]).groupBy(fold).agg(
        _auc().alias("auc"),
        _ap().alias("ap"),
        F.max_by("score", _lowest_best()).alias("threshold"),
        F.max(_f1()).alias("f1"),
    )
