"""Picks, top lists and set operations."""

from pyspark.sql import functions as F

from casesignal.catalog import adapters as a
from casesignal.catalog.registry import query
from casesignal.catalog.safety import model_tables
from casesignal.operators import aggregate, cohort, labels, names
from casesignal.plans import signals as plan

_RANK = "CASE ROLE_COD WHEN 'PS' THEN 0 WHEN 'SS' THEN 1 WHEN 'C' THEN 2 ELSE 99 END"
_PICK = f"""SELECT PRIMARYID, drug_mapped AS picked_drug FROM
    (SELECT *, row_number() OVER (PARTITION BY PRIMARYID ORDER BY {_RANK}, drug_mapped) AS rn
     FROM mapped WHERE drug_mapped IS NOT NULL) WHERE rn = 1"""


def _picked(spark, sf):
    mapped = names.resolve_names(
        a.drug(spark, sf), "DRUGNAME", a.dim(spark, sf), ordinal="ordinal",
        synonyms=a.SYNONYMS, keep_unmatched=False,
    )
    return cohort.pick_primary(mapped, "PRIMARYID", "ROLE_COD", "drug_mapped")


@query("pick_primary", a.with_ctes("mapped", _PICK))
def pick_primary(spark, sf):
    """One exposure per case: PS, then SS, then C, then others."""
    return _picked(spark, sf)


@query(
    "first_per_key",
    a.with_ctes(
        "demo_reports",
        """SELECT PRIMARYID, CAST(VERSION AS BIGINT) AS VERSION, SEX, COUNTRY FROM
        (SELECT *, row_number() OVER (PARTITION BY PRIMARYID ORDER BY VERSION) AS rn FROM demo_reports)
        WHERE rn = 1""",
    ),
)
def first_per_key(spark, sf):
    rows = a.demo_reports(spark, sf).select("PRIMARYID", "VERSION", "SEX", "COUNTRY")
    return aggregate.first_per_key(rows, "PRIMARYID", ["VERSION"])


@query(
    "align_xy",
    a.with_ctes(
        "mapped merged",
        """SELECT m.PRIMARYID, m.drug_mapped, m.SEX, CAST(m.YEAR AS BIGINT) AS YEAR, min(m.PT) AS PT
        FROM merged m JOIN picked p ON m.PRIMARYID = p.PRIMARYID AND m.drug_mapped = p.picked_drug
        GROUP BY ALL""",
        picked=_PICK,
    ),
)
def align_xy(spark, sf):
    """One feature row per labelled case, that of its picked exposure."""
    tables = model_tables(spark, sf)
    x = tables.x.select("PRIMARYID", "drug_mapped", "SEX", "YEAR", "PT")
    return labels.align_xy(
        x, _picked(spark, sf), tables.y, "PRIMARYID", "drug_mapped", "picked_drug", ["PT"]
    )


@query(
    "aligned_features",
    a.with_ctes(
        "mapped merged dim",
        """SELECT m.PRIMARYID, m.drug_mapped, m.AGE, m.AGE_COD, m.SEX, CAST(m.YEAR AS BIGINT) AS YEAR,
        CAST(m.QTR AS BIGINT) AS QTR, CAST(ordinal AS BIGINT) AS ordinal, round(mol_weight, 6) AS mol_weight,
        round(logP, 6) AS logP, round(TPSA, 6) AS TPSA, CAST(HBD AS BIGINT) AS HBD, CAST(HBA AS BIGINT) AS HBA,
        ATC, mechanism_tags
        FROM (SELECT DISTINCT PRIMARYID, drug_mapped, AGE, AGE_COD, SEX, YEAR, QTR FROM merged) m
        JOIN picked p ON m.PRIMARYID = p.PRIMARYID AND m.drug_mapped = p.picked_drug
        JOIN dim ON drug_name = m.drug_mapped""",
        picked=_PICK,
    ),
)
def aligned_features(spark, sf):
    """The same rows with all features, made without pairing outcomes."""
    return plan.aligned_features(
        a.demo(spark, sf), a.drug(spark, sf), a.reac(spark, sf), a.dim(spark, sf),
        ordinal="ordinal", synonyms=a.SYNONYMS,
    )


@query(
    "top_labels",
    a.with_ctes(
        "reac",
        """SELECT PT, count(DISTINCT PRIMARYID) AS n FROM reac WHERE PT IS NOT NULL
        GROUP BY 1 ORDER BY n DESC, PT LIMIT 10""",
    ),
)
def top_labels(spark, sf):
    """The ten commonest outcomes (a top-k report)."""
    return labels.top_labels(a.reac(spark, sf), "PRIMARYID", "PT", 10)


@query(
    "metrics_preview",
    a.with_ctes(
        "named",
        """SELECT DRUG_STD, count(*) AS n_rows, count(DISTINCT PRIMARYID) AS n_cases FROM named
        WHERE DRUG_STD IS NOT NULL GROUP BY 1 ORDER BY n_cases DESC, n_rows DESC, DRUG_STD LIMIT 20""",
    ),
)
def metrics_preview(spark, sf):
    """First twenty names by cases, then rows (a top-k report)."""
    named, _ = names.add_std_name(a.drug(spark, sf), ["DRUGNAME"], "DRUG_STD")
    counts = aggregate.keyed(named, "DRUG_STD").groupBy("DRUG_STD").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("PRIMARYID").alias("n_cases")
    )
    return aggregate.top_rows(counts, 20, ["n_cases", "n_rows"], ["DRUG_STD"])


@query(
    "union_tables",
    """SELECT k, name, balance, extra, count(*) AS n FROM
    (SELECT c_nationkey AS k, c_mktsegment AS name, round(c_acctbal, 6) AS balance, CAST(NULL AS VARCHAR) AS extra FROM customer
     UNION ALL SELECT s_nationkey, CAST(NULL AS VARCHAR), round(s_acctbal, 6), s_name FROM supplier)
    GROUP BY ALL""".replace("SELECT k,", "SELECT CAST(k AS BIGINT) AS k,", 1),
)
def union_tables(spark, sf):
    """Union by name; a column that one side lacks is null there."""
    left = a.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("balance")
    )
    right = a.table(spark, sf, "supplier").select(
        F.col("s_name").alias("extra"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("k")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy("k", "name", "balance", "extra").agg(F.count(F.lit(1)).alias("n"))


@query(
    "distinct_rows",
    "SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem",
)
def distinct_rows(spark, sf):
    return a.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()
