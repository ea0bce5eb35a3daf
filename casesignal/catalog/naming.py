"""Names and cohorts."""

from pyspark.sql import functions as F

from casesignal.catalog import adapters as a
from casesignal.catalog.registry import query
from casesignal.functions import text
from casesignal.operators import cohort, names
from casesignal.sources.contract import ensure_columns, fill_nulls, require_columns, resolve_column


def _counted(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "name_fold",
    a.with_ctes(
        "drug",
        f"""SELECT DRUGNAME, {a.sql_fold('DRUGNAME')} AS folded, {a.sql_key('DRUGNAME')} AS looked_up,
        count(*) AS n FROM drug GROUP BY ALL""",
    ),
)
def name_fold(spark, sf):
    named = a.drug(spark, sf).withColumns(
        {
            "folded": text.fold_separators(F.col("DRUGNAME")),
            "looked_up": text.lookup_key(F.col("DRUGNAME")),
        }
    )
    return _counted(named, "DRUGNAME", "folded", "looked_up")


@query(
    "name_collapse",
    a.with_ctes(
        "drug", f"SELECT {a.sql_collapse('DRUGNAME')} AS name, count(*) AS n FROM drug GROUP BY ALL"
    ),
)
def name_collapse(spark, sf):
    return _counted(a.drug(spark, sf).select(text.collapse_ws(F.col("DRUGNAME")).alias("name")), "name")


@query(
    "name_std",
    a.with_ctes(
        "drug",
        f"""SELECT {a.sql_std('DRUGNAME')} AS name_std, 'DRUGNAME' AS used,
        CAST(NULL AS VARCHAR) AS absent, count(*) AS n FROM drug GROUP BY ALL""",
    ),
)
def name_std(spark, sf):
    named, used = names.add_std_name(a.drug(spark, sf), ["DRUGNAME_STD", "DRUGNAME"], "name_std")
    named, _ = names.add_std_name(named, ["no_such_column"], "absent")
    return _counted(named.withColumn("used", F.lit(used)), "name_std", "used", "absent")


@query(
    "name_std_null_token",
    a.with_ctes(
        "drug",
        f"""SELECT {a.sql_std("coalesce(DRUGNAME, 'NONE')")} AS name_std, count(*) AS n
        FROM drug GROUP BY ALL""",
    ),
)
def name_std_null_token(spark, sf):
    named, _ = names.add_std_name(a.drug(spark, sf), ["DRUGNAME"], "name_std", null_token="NONE")
    return _counted(named, "name_std")


@query(
    "first_token",
    a.with_ctes(
        "drug",
        rf"""SELECT DRUGNAME, regexp_extract({a.sql_key('DRUGNAME')}, '^\s*(\S*)', 1) AS token,
        count(*) AS n FROM drug GROUP BY ALL""",
    ),
)
def first_token(spark, sf):
    key = text.lookup_key(F.col("DRUGNAME"))
    return _counted(a.drug(spark, sf).withColumn("token", text.first_token(key)), "DRUGNAME", "token")


@query(
    "brand_map",
    a.with_ctes("generic", "SELECT DRUG_STD, GENERIC_STD, count(*) AS n FROM generic GROUP BY ALL"),
)
def brand_map(spark, sf):
    named = a.drug(spark, sf).withColumn("DRUG_STD", text.std_name(F.col("DRUGNAME")))
    return _counted(names.map_brand(named, "DRUG_STD", "GENERIC_STD", a.BRANDS), "DRUG_STD", "GENERIC_STD")


@query(
    "brand_map_table",
    a.with_ctes("generic", "SELECT DRUG_STD, GENERIC_STD, count(*) AS n FROM generic GROUP BY ALL"),
)
def brand_map_table(spark, sf):
    """The same with the dictionary as a table."""
    mapping = spark.createDataFrame(list(a.BRANDS.items()), "key string, value string")
    named = a.drug(spark, sf).withColumn("DRUG_STD", text.std_name(F.col("DRUGNAME")))
    return _counted(names.map_brand(named, "DRUG_STD", "GENERIC_STD", mapping), "DRUG_STD", "GENERIC_STD")


_CASCADE = a.with_ctes("mapped", "SELECT DRUGNAME, drug_mapped, count(*) AS n FROM mapped GROUP BY ALL")


@query("resolve_cascade", _CASCADE)
def resolve_cascade(spark, sf):
    mapped = names.resolve_names(
        a.drug(spark, sf), "DRUGNAME", a.dim(spark, sf), ordinal="ordinal", synonyms=a.SYNONYMS
    )
    return _counted(mapped, "DRUGNAME", "drug_mapped")


@query("resolve_cascade_large_dim", _CASCADE)
def resolve_cascade_large_dim(spark, sf):
    """The path for a dimension too large to write into an expression."""
    mapped = names.resolve_names(
        a.drug(spark, sf), "DRUGNAME", a.dim(spark, sf), ordinal="ordinal",
        synonyms=a.SYNONYMS, inline_rows=0,
    )
    return _counted(mapped, "DRUGNAME", "drug_mapped")


_TERMS_SQL = "|".join(a.TERMS)


@query(
    "term_match",
    a.with_ctes(
        "named",
        f"""SELECT DRUG_STD, CAST(regexp_matches(coalesce(DRUG_STD, ''), '{_TERMS_SQL}') AS BIGINT) AS in_cohort,
        count(*) AS n FROM named GROUP BY ALL""",
    ),
)
def term_match(spark, sf):
    named = a.drug(spark, sf).withColumn("DRUG_STD", text.std_name(F.col("DRUGNAME")))
    return _counted(cohort.match_terms(named, "DRUG_STD", a.TERMS), "DRUG_STD", "in_cohort")


def _dim_names(spark, sf):
    return a.dim(spark, sf).select(text.std_name(F.col("drug_name")).alias("NAME_STD"))


@query(
    "allow_list",
    a.with_ctes(
        "generic dim",
        f"""SELECT GENERIC_STD, count(*) AS n FROM generic
        WHERE GENERIC_STD IN (SELECT {a.sql_std('drug_name')} FROM dim) GROUP BY ALL""",
    ),
)
def allow_list(spark, sf):
    named = a.drug(spark, sf).withColumn("DRUG_STD", text.std_name(F.col("DRUGNAME")))
    generic = names.map_brand(named, "DRUG_STD", "GENERIC_STD", a.BRANDS)
    return _counted(cohort.allow_list(generic, "GENERIC_STD", _dim_names(spark, sf), "NAME_STD"), "GENERIC_STD")


@query(
    "unmatched_names",
    a.with_ctes(
        "generic dim",
        f"""SELECT DISTINCT DRUGNAME, DRUG_STD FROM generic g WHERE NOT EXISTS
        (SELECT 1 FROM dim WHERE {a.sql_std('drug_name')} = g.GENERIC_STD)""",
    ),
)
def unmatched_names(spark, sf):
    named = a.drug(spark, sf).withColumn("DRUG_STD", text.std_name(F.col("DRUGNAME")))
    generic = names.map_brand(named, "DRUG_STD", "GENERIC_STD", a.BRANDS)
    return cohort.unmatched_names(
        generic, "GENERIC_STD", _dim_names(spark, sf), "NAME_STD", ["DRUGNAME", "DRUG_STD"]
    )


@query(
    "role_filter",
    a.with_ctes(
        "drug", "SELECT ROLE_COD, count(*) AS n FROM drug WHERE ROLE_COD IN ('PS', 'SS', 'C') GROUP BY ALL"
    ),
)
def role_filter(spark, sf):
    return _counted(cohort.keep_roles(a.drug(spark, sf), "ROLE_COD"), "ROLE_COD")


@query(
    "prefer_role",
    a.with_ctes(
        "drug",
        """SELECT 'present' AS wanted, ROLE_COD, count(*) AS n FROM drug WHERE upper(ROLE_COD) = 'PS' GROUP BY ALL
        UNION ALL SELECT 'absent', ROLE_COD, count(*) FROM drug GROUP BY ALL""",
    ),
)
def prefer_role(spark, sf):
    """A role that occurs, and one that does not (then all rows stay)."""
    rows = a.drug(spark, sf)
    present = _counted(cohort.prefer_role(rows, "ROLE_COD"), "ROLE_COD")
    absent = _counted(cohort.prefer_role(rows, "ROLE_COD", "ZZ"), "ROLE_COD")
    return present.select(F.lit("present").alias("wanted"), "*").unionByName(
        absent.select(F.lit("absent").alias("wanted"), "*")
    )


@query(
    "drop_nulls",
    a.with_ctes(
        "drug reac",
        """SELECT 'drug' AS tbl, count(*) AS n FROM drug WHERE DRUGNAME IS NOT NULL AND ROLE_COD IS NOT NULL
        UNION ALL SELECT 'reac', count(*) FROM reac WHERE PT IS NOT NULL""",
    ),
)
def drop_nulls(spark, sf):
    drug = a.drug(spark, sf).dropna(subset=["DRUGNAME", "ROLE_COD"])
    reac = a.reac(spark, sf).dropna(subset=["PT"])
    return drug.select(F.lit("drug").alias("tbl")).unionByName(
        reac.select(F.lit("reac").alias("tbl"))
    ).groupBy("tbl").agg(F.count(F.lit(1)).alias("n"))


@query(
    "column_resolution",
    """SELECT c_custkey AS case_id, 'c_custkey' AS used, CAST(NULL AS DOUBLE) AS weight,
    0::BIGINT AS n_drugs, c_mktsegment AS segment FROM customer""",
)
def column_resolution(spark, sf):
    """First existing column, missing columns as null, fills, contract."""
    rows = require_columns(a.table(spark, sf, "customer"), ["c_custkey", "c_mktsegment"], "customer")
    used = resolve_column(rows, ["CASEID", "PRIMARYID", "c_custkey", "c_name"])
    full = ensure_columns(rows, {"weight": "double", "n_drugs": "int", "c_mktsegment": "string"})
    return fill_nulls(full, {"n_drugs": 0}).select(
        F.col(used).alias("case_id"), F.lit(used).alias("used"), "weight", "n_drugs",
        F.col("c_mktsegment").alias("segment"),
    )


@query(
    "cohort_counts",
    a.with_ctes(
        "generic dim",
        f"""SELECT count(*) AS n_records, count(DISTINCT PRIMARYID) AS n_cases FROM generic
        WHERE GENERIC_STD IN (SELECT {a.sql_std('drug_name')} FROM dim)""",
    ),
)
def cohort_counts(spark, sf):
    named = a.drug(spark, sf).withColumn("DRUG_STD", text.std_name(F.col("DRUGNAME")))
    generic = names.map_brand(named, "DRUG_STD", "GENERIC_STD", a.BRANDS)
    return cohort.cohort_counts(
        cohort.allow_list(generic, "GENERIC_STD", _dim_names(spark, sf), "NAME_STD"), "PRIMARYID"
    )
