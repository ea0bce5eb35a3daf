"""Counts, sums, statistics and pivots per case."""

from pyspark.sql import functions as F

from casesignal.catalog import adapters as a
from casesignal.catalog.registry import query
from casesignal.functions.scalars import ratio_if_positive
from casesignal.functions.text import split_tags
from casesignal.operators import aggregate, labels, relate


@query(
    "distinct_per_case",
    a.with_ctes(
        "drug", "SELECT PRIMARYID, count(DISTINCT DRUGNAME) AS n_names FROM drug GROUP BY 1"
    ),
)
def distinct_per_case(spark, sf):
    return aggregate.distinct_per(a.drug(spark, sf), "PRIMARYID", "DRUGNAME", "n_names")


@query(
    "case_totals",
    a.with_ctes("reac", "SELECT count(*) AS n_records, count(DISTINCT PRIMARYID) AS n_cases FROM reac"),
)
def case_totals(spark, sf):
    from casesignal.operators.cohort import cohort_counts

    return cohort_counts(a.reac(spark, sf), "PRIMARYID")


@query(
    "rows_per_case",
    a.with_ctes("reac", "SELECT PRIMARYID, count(*) AS ADR_count FROM reac GROUP BY 1"),
)
def rows_per_case(spark, sf):
    return aggregate.rows_per(a.reac(spark, sf), "PRIMARYID", "ADR_count")


@query(
    "non_null_per_case",
    a.with_ctes(
        "drug",
        """SELECT PRIMARYID, count(DRUGNAME) AS n_named, count(*) AS n_rows,
        count(ROUTE) AS n_routes FROM drug GROUP BY 1""",
    ),
)
def non_null_per_case(spark, sf):
    return aggregate.keyed(a.drug(spark, sf), "PRIMARYID").groupBy("PRIMARYID").agg(
        F.count("DRUGNAME").alias("n_named"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count("ROUTE").alias("n_routes"),
    )


@query(
    "property_stats",
    """SELECT l_orderkey, round(avg(x), 6) AS x_mean, round(max(x), 6) AS x_max, round(min(x), 6) AS x_min,
    round(coalesce(sum(x), 0), 6) AS x_sum, round(stddev_samp(x), 6) AS x_std
    FROM (SELECT l_orderkey, CASE WHEN l_linenumber > 3 THEN l_quantity END AS x FROM lineitem)
    GROUP BY 1""",
)
def property_stats(spark, sf):
    """Statistics of a column that is null in part; an empty sum is 0."""
    rows = a.table(spark, sf, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") > 3, F.col("l_quantity")).alias("x")
    )
    stats = aggregate.property_stats({"x": ("mean", "max", "min", "sum", "std")})
    return rows.groupBy("l_orderkey").agg(*stats)


@query(
    "first_non_null",
    a.with_ctes(
        "demo_reports",
        """SELECT PRIMARYID, arg_min(SEX, VERSION) FILTER (WHERE SEX IS NOT NULL) AS SEX,
        arg_min(COUNTRY, VERSION) FILTER (WHERE COUNTRY IS NOT NULL) AS COUNTRY,
        arg_min(EVENT_DT, VERSION) FILTER (WHERE EVENT_DT IS NOT NULL) AS EVENT_DT
        FROM demo_reports GROUP BY 1""",
    ),
)
def first_non_null(spark, sf):
    return a.demo_reports(spark, sf).groupBy("PRIMARYID").agg(
        *[aggregate.first_non_null(c, ["VERSION"]).alias(c) for c in ("SEX", "COUNTRY", "EVENT_DT")]
    )


@query(
    "guarded_ratio",
    """SELECT l_orderkey, total, n, round(CASE WHEN n > 0 THEN total / n END, 6) AS per_unit FROM
    (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS total,
     CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM lineitem GROUP BY 1)""",
)
def guarded_ratio(spark, sf):
    counts = a.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum((F.col("l_returnflag") == "R").cast("int")).alias("n"),
    )
    return counts.withColumn("per_unit", ratio_if_positive(F.col("total"), F.col("n")))


_ROLES = ("UNK", "PS", "SS", "C", "I")


@query(
    "role_pivot",
    a.with_ctes(
        "drug",
        "SELECT PRIMARYID, "
        + ", ".join(
            f"count(DISTINCT CASE WHEN coalesce(ROLE_COD, 'UNK') = '{r}' THEN DRUGNAME END) AS role_{r.lower()}"
            for r in _ROLES
        )
        + " FROM drug GROUP BY 1",
    ),
)
def role_pivot(spark, sf):
    """Distinct names per case and role; a missing role is its own column."""
    return aggregate.distinct_by_category(
        a.drug(spark, sf), "PRIMARYID", "ROLE_COD", "DRUGNAME", _ROLES, "role_"
    )


_TOP = """SELECT PT, row_number() OVER (ORDER BY n DESC, PT) AS k FROM
    (SELECT PT, count(DISTINCT PRIMARYID) AS n FROM reac WHERE PT IS NOT NULL GROUP BY 1)"""


@query(
    "label_matrix_topk",
    a.with_ctes(
        "reac",
        "SELECT PRIMARYID, "
        + ", ".join(f"CAST(max(CASE WHEN k = {i + 1} THEN 1 ELSE 0 END) AS BIGINT) AS top_{i}" for i in range(8))
        + " FROM reac JOIN ranked USING (PT) GROUP BY 1",
        ranked=_TOP,
    ),
)
def label_matrix_topk(spark, sf):
    """0/1 columns of the eight commonest outcomes."""
    reac = a.reac(spark, sf)
    top = labels.label_names(reac, "PRIMARYID", "PT", 8)
    return labels.label_matrix(reac, "PRIMARYID", "PT", top, [f"top_{i}" for i in range(len(top))])


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "mechanism_counts",
    a.with_ctes(
        "pairs dim",
        "SELECT PRIMARYID, "
        + ", ".join(f"CAST(sum(CASE WHEN tag = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{t}\"" for t in _TYPES)
        + """ FROM (SELECT PRIMARYID, unnest(string_split(mechanism_tags, ';')) AS tag
             FROM mapped JOIN dim ON drug_name = drug_mapped WHERE mechanism_tags <> '') GROUP BY 1""",
    ),
)
def mechanism_counts(spark, sf):
    """How often each mechanism tag occurs per case; duplicates add up."""
    from casesignal.operators import names

    mapped = names.resolve_names(
        a.drug(spark, sf), "DRUGNAME", a.dim(spark, sf), ordinal="ordinal", synonyms=a.SYNONYMS
    )
    rows = relate.attach_dimension(mapped, a.dim(spark, sf), "drug_mapped", "drug_name")
    tagged = rows.withColumn("tags", split_tags(F.col("mechanism_tags")))
    return aggregate.tag_counts(tagged, "PRIMARYID", "tags", _TYPES)


@query(
    "flag_share",
    a.with_ctes(
        "drug",
        """SELECT PRIMARYID, round(avg(CASE WHEN ROLE_COD = 'PS' THEN 1 ELSE 0 END), 6) AS ps_share
        FROM drug GROUP BY 1""",
    ),
)
def flag_share(spark, sf):
    flagged = a.drug(spark, sf).select(
        "PRIMARYID", F.coalesce((F.col("ROLE_COD") == "PS").cast("int"), F.lit(0)).alias("f")
    )
    return aggregate.mean_by(flagged, "PRIMARYID", "f", "ps_share")


@query(
    "label_frequencies",
    a.with_ctes("reac", "SELECT PT, count(DISTINCT PRIMARYID) AS n FROM reac WHERE PT IS NOT NULL GROUP BY 1"),
)
def label_frequencies(spark, sf):
    """Column sums of the 0/1 matrix."""
    return aggregate.value_frequencies(a.reac(spark, sf), "PRIMARYID", "PT")


@query(
    "labels_per_case",
    a.with_ctes("reac", "SELECT PRIMARYID, count(DISTINCT PT) AS n FROM reac WHERE PT IS NOT NULL GROUP BY 1"),
)
def labels_per_case(spark, sf):
    """Row sums of the 0/1 matrix."""
    return aggregate.values_per_key(a.reac(spark, sf), "PRIMARYID", "PT")


@query(
    "mean_over_folds",
    a.with_ctes("scored", "SELECT CAST(fold AS BIGINT) AS fold, round(avg(score), 6) AS score FROM scored GROUP BY 1"),
)
def mean_over_folds(spark, sf):
    return aggregate.mean_by(a.scored(spark, sf), "fold", "score")
