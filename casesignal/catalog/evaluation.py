"""Evaluation of scored rows, correlations."""

from pyspark.sql import functions as F

from casesignal.catalog import adapters as a
from casesignal.catalog.registry import query
from casesignal.operators import evaluate, stats
from casesignal.plans import train


def _curve(source: str, by: str = "") -> dict[str, str]:
    """SQL fragments: counts per distinct score, with running sums."""
    part = f"PARTITION BY {by} " if by else ""
    group = f"{by}, " if by else ""
    return {
        "counts": f"""SELECT {group}score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg
            FROM {source} GROUP BY {group}score""",
        "curve": f"""SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) AS tp,
            sum(neg) OVER ({part}ORDER BY score DESC) AS fp,
            sum(neg) OVER ({part}ORDER BY score) - neg AS neg_below,
            sum(pos) OVER ({part.strip()}) AS p, sum(neg) OVER ({part.strip()}) AS n FROM counts""",
        "f1": f"""SELECT *, 2 * tp / (p + tp + fp) AS f1,
            lag(score) OVER ({part}ORDER BY score) AS below FROM curve""",
    }


_AUC = "sum(pos * (neg_below + neg / 2)) / nullif(max(p) * max(n), 0)"
_AP = "sum(pos * (tp / (tp + fp))) / nullif(max(p), 0)"


@query("roc_auc", a.with_ctes("scored", f"SELECT round({_AUC}, 6) AS auc FROM curve", **_curve("scored")))
def roc_auc(spark, sf):
    return evaluate.roc_auc(a.scored(spark, sf), "y", "score")


@query(
    "roc_auc_per_label",
    a.with_ctes(
        "scored_labels",
        f"SELECT label, round({_AUC}, 6) AS auc FROM curve GROUP BY 1",
        **_curve("scored_labels", "label"),
    ),
)
def roc_auc_per_label(spark, sf):
    return evaluate.roc_auc(a.scored_labels(spark, sf), "y", "score", ["label"])


@query("average_precision", a.with_ctes("scored", f"SELECT round({_AP}, 6) AS ap FROM curve", **_curve("scored")))
def average_precision(spark, sf):
    return evaluate.average_precision(a.scored(spark, sf), "y", "score")


@query(
    "pr_curve",
    a.with_ctes(
        "scored",
        """SELECT CAST(fold AS BIGINT) AS fold, round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
        round(tp / nullif(p, 0), 6) AS recall FROM curve
        UNION ALL SELECT DISTINCT CAST(fold AS BIGINT), CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE FROM curve""",
        **_curve("scored", "fold"),
    ),
)
def pr_curve(spark, sf):
    return evaluate.pr_curve(a.scored(spark, sf), "y", "score", ["fold"])


_NULL_GROUP = "SELECT CASE WHEN id % 6 <> 0 THEN fold END AS part, y, score FROM scored"


@query(
    "roc_auc_null_group",
    a.with_ctes(
        "scored",
        f"SELECT CAST(part AS BIGINT) AS part, round({_AUC}, 6) AS auc FROM curve GROUP BY 1",
        parts=_NULL_GROUP,
        **_curve("parts", "part"),
    ),
)
def roc_auc_null_group(spark, sf):
    """A null label is a group like any other."""
    rows = a.scored(spark, sf).withColumn("part", F.when(F.col("id") % 6 != 0, F.col("fold")))
    return evaluate.roc_auc(rows, "y", "score", ["part"])


@query(
    "pr_curve_continuous",
    a.with_ctes(
        "scored_labels",
        """SELECT label, round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
        round(tp / nullif(p, 0), 6) AS recall FROM curve
        UNION ALL SELECT DISTINCT label, CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE FROM curve""",
        **_curve("scored_labels", "label"),
    ),
)
def pr_curve_continuous(spark, sf):
    """The curve where hardly any scores are equal."""
    return evaluate.pr_curve(a.scored_labels(spark, sf), "y", "score", ["label"])


@query(
    "best_threshold",
    a.with_ctes(
        "scored",
        """SELECT CAST(fold AS BIGINT) AS fold, round(score, 6) AS threshold, round(f1, 6) AS f1 FROM
        (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, score) AS rn FROM f1) WHERE rn = 1""",
        **_curve("scored", "fold"),
    ),
)
def best_threshold(spark, sf):
    return evaluate.best_threshold(a.scored(spark, sf), "y", "score", ["fold"])


def _stepped(source: str, by: str, low: float) -> str:
    part = f"PARTITION BY {by} " if by else ""
    head = f"{by}, " if by else ""
    return a.with_ctes(
        source,
        f"""SELECT {head}round(CASE WHEN p = 0 OR n = 0 OR below IS NULL THEN 0.5::DOUBLE
        ELSE greatest(least(below, 0.99::DOUBLE), {low}::DOUBLE) END, 6) AS threshold FROM
        (SELECT *, row_number() OVER ({part}ORDER BY f1 DESC, score) AS rn FROM f1) WHERE rn = 1""",
        **_curve(source, by),
    )


@query("label_thresholds", _stepped("scored_labels", "label", 0.01))
def label_thresholds(spark, sf):
    """One step below the best, per label."""
    return evaluate.stepped_threshold(a.scored_labels(spark, sf), "y", "score", ["label"])


@query("binary_threshold", _stepped("scored", "", 0.3))
def binary_threshold(spark, sf):
    return evaluate.stepped_threshold(a.scored(spark, sf), "y", "score", low=0.3)


_GRID = ", ".join(f"({t!r}::DOUBLE)" for t in evaluate.THRESHOLD_GRID)
_GRID_PICK = {
    "tries": f"""SELECT label, t AS threshold, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM
        (SELECT label, t, sum(CASE WHEN score >= t AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
         sum(CASE WHEN score >= t AND y = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp,
         sum(CASE WHEN score < t AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn
         FROM scored_labels, (VALUES {_GRID}) g(t) GROUP BY ALL)""",
    "picked": """SELECT label, threshold, f1 FROM
        (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold) AS rn FROM tries) WHERE rn = 1""",
    "pred": """SELECT s.*, CAST(score >= threshold AS INT) AS pred FROM scored_labels s JOIN picked USING (label)""",
    "cells": """SELECT label, sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
        sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
        sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn FROM pred GROUP BY 1""",
}


@query(
    "threshold_grid",
    a.with_ctes(
        "scored_labels",
        "SELECT label, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM picked",
        **_GRID_PICK,
    ),
)
def threshold_grid(spark, sf):
    return evaluate.grid_threshold(a.scored_labels(spark, sf), "y", "score", ["label"])


def _predicted(spark, sf):
    rows = a.scored_labels(spark, sf)
    return evaluate.apply_threshold(
        rows, "score", evaluate.grid_threshold(rows, "y", "score", ["label"]), ["label"]
    )


@query(
    "apply_threshold",
    a.with_ctes(
        "scored_labels",
        "SELECT label, CAST(y AS BIGINT) AS y, CAST(pred AS BIGINT) AS pred, count(*) AS n FROM pred GROUP BY ALL",
        **_GRID_PICK,
    ),
)
def apply_threshold(spark, sf):
    """Per-label thresholds on all rows, counted by outcome."""
    return _predicted(spark, sf).groupBy("label", "y", "pred").agg(F.count(F.lit(1)).alias("n"))


@query(
    "apply_threshold_missing",
    a.with_ctes(
        "scored_labels",
        """SELECT label, CAST(y AS BIGINT) AS y,
        CAST(score >= CASE WHEN label = 'purchase' THEN 0.5 ELSE 0.25 END AS BIGINT) AS pred, count(*) AS n
        FROM scored_labels GROUP BY ALL""",
    ),
)
def apply_threshold_missing(spark, sf):
    """A label without a threshold takes 0.5; none of its rows is lost."""
    rows = a.scored_labels(spark, sf)
    limits = rows.where("label <> 'purchase'").groupBy("label").agg(F.lit(0.25).alias("threshold"))
    return evaluate.apply_threshold(rows, "score", limits, ["label"]).groupBy("label", "y", "pred").agg(F.count("*").alias("n"))


_CELLS = """SELECT {by} CAST(sum(CASE WHEN y = 0 AND score < 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN y = 0 AND score >= 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN y = 1 AND score < 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN y = 1 AND score >= 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM scored {group}"""


def _at_forty(spark, sf):
    return evaluate.apply_threshold(a.scored(spark, sf), "score", 0.4)


@query(
    "confusion",
    a.with_ctes("scored", _CELLS.format(by="CAST(fold AS BIGINT) AS fold,", group="GROUP BY 1")),
)
def confusion(spark, sf):
    return evaluate.confusion(_at_forty(spark, sf), "y", "pred", ["fold"])


@query(
    "classification_report",
    a.with_ctes(
        "scored",
        """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
        CAST(support AS BIGINT) AS support FROM
        (SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM m
         UNION ALL SELECT '1', p1, r1, f1, n1 FROM m
         UNION ALL SELECT 'accuracy', acc, acc, acc, n0 + n1 FROM m
         UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 FROM m
         UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1),
            (f0 * n0 + f1 * n1) / (n0 + n1), n0 + n1 FROM m)""",
        c=_CELLS.format(by="", group=""),
        m="""SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0,
        tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fn + fp) AS f1,
        (tp + tn) / (tn + fp + fn + tp) AS acc, tn + fp AS n0, fn + tp AS n1 FROM c""",
    ),
)
def classification_report(spark, sf):
    return evaluate.classification_report(evaluate.confusion(_at_forty(spark, sf), "y", "pred"))


@query(
    "binary_metrics",
    a.with_ctes(
        "scored",
        """SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
        round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
        c=_CELLS.format(by="", group=""),
    ),
)
def binary_metrics(spark, sf):
    return evaluate.binary_metrics(_at_forty(spark, sf), "y", "pred")


@query(
    "micro_macro_f1",
    a.with_ctes(
        "scored_labels",
        """SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1,
        round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM cells""",
        **_GRID_PICK,
    ),
)
def micro_macro_f1(spark, sf):
    return evaluate.micro_macro_f1(_predicted(spark, sf), "y", "pred", "label")


_RANKED = """SELECT {by} (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
    / nullif(sum(y)::DOUBLE * sum(1 - y), 0) AS auc FROM
    (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({part2} score) - 1) / 2.0::DOUBLE AS r
     FROM scored_labels) {group}"""


@query(
    "micro_macro_auc",
    a.with_ctes(
        "scored_labels",
        """SELECT (SELECT round(auc, 6) FROM pooled) AS micro_auc,
        round(CASE WHEN count(auc) = count(*) THEN avg(auc) END, 6) AS macro_auc FROM per""",
        pooled=_RANKED.format(by="", part="", part2="PARTITION BY", group=""),
        per=_RANKED.format(
            by="label,", part="PARTITION BY label", part2="PARTITION BY label,", group="GROUP BY label"
        ),
    ),
)
def micro_macro_auc(spark, sf):
    return evaluate.micro_macro_auc(a.scored_labels(spark, sf), "y", "score", "label")


@query(
    "mean_auc",
    a.with_ctes(
        "scored_labels",
        "SELECT round(avg(auc), 6) AS mean_auc, count(auc) AS n_labels FROM per",
        per=_RANKED.format(
            by="label,", part="PARTITION BY label", part2="PARTITION BY label,", group="GROUP BY label"
        ),
    ),
)
def mean_auc(spark, sf):
    """Mean over the labels that have both classes."""
    return evaluate.mean_auc(a.scored_labels(spark, sf), "y", "score", "label")


@query(
    "fold_metrics",
    a.with_ctes(
        "scored",
        f"""SELECT CAST(fold AS BIGINT) AS fold, round(auc, 6) AS auc, round(ap, 6) AS ap,
        round(score, 6) AS threshold, round(f1, 6) AS f1 FROM
        (SELECT fold, {_AUC} AS auc, {_AP} AS ap FROM curve GROUP BY 1) JOIN
        (SELECT fold, score, f1, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, score) AS rn FROM f1)
        USING (fold) WHERE rn = 1""",
        **_curve("scored", "fold"),
    ),
)
def fold_metrics(spark, sf):
    return evaluate.fold_metrics(a.scored(spark, sf), "y", "score", "fold")


@query(
    "rescaled_scores",
    """SELECT event_id, round((value - lo) / (hi - lo + 1e-9), 6) AS score
    FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)""",
)
def rescaled_scores(spark, sf):
    rows = a.table(spark, sf, "events").select("event_id", "value")
    return train.rescaled_scores(rows, "value").select("event_id", "score")


_PAIRS = [(p, t) for p in ("l_quantity", "l_discount") for t in ("l_extendedprice", "l_tax")]
_SPEARMAN = {
    "long": " UNION ALL ".join(
        f"SELECT '{p}' AS prop, '{t}' AS target, {p} AS x, {t} AS y FROM lineitem" for p, t in _PAIRS
    ),
    "ranked": """SELECT *, rank() OVER (PARTITION BY prop, target ORDER BY x)
            + (count(*) OVER (PARTITION BY prop, target, x) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (PARTITION BY prop, target ORDER BY y)
            + (count(*) OVER (PARTITION BY prop, target, y) - 1) / 2.0::DOUBLE AS ry FROM long""",
    "rho": "SELECT prop, target, count(*) AS n, corr(rx, ry) AS rho FROM ranked GROUP BY 1, 2 HAVING count(*) > 3",
}


def _correlations(spark, sf):
    rows = a.table(spark, sf, "lineitem")
    return stats.spearman(rows, ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"])


@query(
    "spearman",
    "WITH "
    + ", ".join(f"{k} AS ({v})" for k, v in _SPEARMAN.items())
    + " SELECT prop, target, n, round(rho, 6) AS rho, round(rho * sqrt((n - 2) / (1 - rho * rho)), 6) AS t FROM rho",
)
def spearman(spark, sf):
    return _correlations(spark, sf)


@query(
    "spearman_p_value",
    "WITH "
    + ", ".join(f"{k} AS ({v})" for k, v in _SPEARMAN.items())
    + """, tt AS (SELECT prop, target, n, (n - 2)::DOUBLE AS df,
            least(abs(rho * sqrt((n - 2) / (1 - rho * rho))), 40.0::DOUBLE) AS t FROM rho),
        area AS (SELECT prop, target, sum(CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
            * pow(1 + pow(t * i / 20000.0::DOUBLE, 2) / df, -(df + 1) / 2)) * max(t) / 60000.0::DOUBLE
            * max(exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())) AS half
            FROM tt, range(20001) r(i) GROUP BY 1, 2)
        SELECT prop, target, round(greatest(1 - 2 * half, 0), 6) AS p_value FROM area""",
)
def spearman_p_value(spark, sf):
    """Two-sided p-value of each rho (t distribution)."""
    return stats.with_p_value(_correlations(spark, sf)).select("prop", "target", "p_value")


@query(
    "scatter_points",
    a.with_ctes(
        "demo_reports",
        "SELECT AGE_YR, CAST(SERIOUS AS BIGINT) AS SERIOUS, COUNTRY FROM demo_reports WHERE AGE_YR IS NOT NULL AND SERIOUS IS NOT NULL AND COUNTRY IS NOT NULL",
    ),
)
def scatter_points(spark, sf):
    return stats.points(a.demo_reports(spark, sf), "AGE_YR", "SERIOUS", "COUNTRY")
