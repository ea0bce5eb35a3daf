"""The test tables in the roles of the case-report model, and the same in SQL.

orders are the cases, lineitem x part the exposures, lineitem x supplier x
nation the outcomes, part the source of the compound properties, events the
scored rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimension names in order; they hit all four steps of the name cascade.
DIM_NAMES = (
    "Red Plate", "Blue", "Anvil", "Old Gear", "Small Gizmo",
    "New Rod", "Cold Ring", "Hot Bolt", "Widget", "Large",
)
SYNONYMS = {"HOT": "Red Plate", "COLD": "Small Gizmo"}
BRANDS = {
    "HOT BOLT": "RED PLATE", "COLD BOLT": "OLD GEAR", "LARGE ROD": "ANVIL",
    "BLUE RING": "BLUE", "BLUE BOLT": "BLUE", "HOT ANVIL": "ANVIL",
    "RED WIDGET": "WIDGET", "OLD WIDGET": "WIDGET", "LARGE GEAR": "LARGE",
}
TERMS = ("ANVIL", "PLATE", "GEAR", "OLD R", "BLUE BOLT")
EVENT_LABELS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null_if(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    return o.select(
        key.alias("PRIMARYID"),
        _null_if(F.col("o_custkey") % 7 == 0, (F.col("o_custkey") % 130).cast("double")).alias("AGE"),
        F.lit("YR").alias("AGE_COD"),
        F.when(F.col("o_orderstatus") == "F", "F").when(F.col("o_orderstatus") == "O", "M").alias("SEX"),
        F.when(key % 11 == 0, F.substring(day, 1, 6)).otherwise(day).alias("FDA_DT"),
    )


def demo_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As demo_reports, but some cases are missing: one side of an outer join."""
    return demo_reports(spark, sf_dir).where("PRIMARYID % 23 <> 0")


def demo_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case; some have a second report version."""
    o = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    age = _null_if(F.col("o_custkey") % 7 == 0, (F.col("o_custkey") % 230).cast("double"))
    first = o.select(
        key.alias("PRIMARYID"),
        F.lit(1).alias("VERSION"),
        age.alias("AGE_YR"),
        F.when(F.col("o_orderstatus") == "F", "F").when(F.col("o_orderstatus") == "O", "M").alias("SEX"),
        _null_if(key % 13 == 0, (F.col("o_totalprice") > 250000).cast("int")).alias("SERIOUS"),
        _null_if(key % 17 == 0, F.col("o_orderpriority")).alias("I_F_COD"),
        _null_if(key % 19 == 0, F.concat(F.lit("C"), (F.col("o_custkey") % 25).cast("string"))).alias("COUNTRY"),
        _null_if(key % 5 == 0, day).alias("EVENT_DT"),
        _null_if(key % 3 == 0, day).alias("REPT_DT"),
    )
    second = o.where(key % 4 == 0).select(
        key.alias("PRIMARYID"),
        F.lit(2).alias("VERSION"),
        F.lit(50.0).alias("AGE_YR"),
        F.lit("M").alias("SEX"),
        F.when(key % 8 == 0, 1).alias("SERIOUS"),
        F.lit("LATE").alias("I_F_COD"),
        F.lit("X").alias("COUNTRY"),
        F.lit("20200101").alias("EVENT_DT"),
        F.lit("20200102").alias("REPT_DT"),
    )
    return first.unionByName(second)


def drug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure rows; names are decorated the way free text is."""
    rows = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    n, d = F.col("p_name"), F.col("l_partkey") % 10
    blank = F.lit(" ")
    name = (
        F.when(d == 0, F.upper(n))
        .when(d == 1, F.replace(n, blank, F.lit("-")))
        .when(d == 2, F.concat(F.lit("  "), n, blank))
        .when(d == 3, F.concat(F.lit('"'), n, F.lit('"')))
        .when(d == 4, F.replace(n, blank, F.lit("_")))
        .when(d == 5, F.replace(n, blank, F.lit("   ")))
        .when(d == 6, F.concat(n, F.lit(" XR")))
        .when(d == 7, F.concat(F.lit("x "), n))
        .when(d == 8, F.replace(n, blank, F.lit("\t")))
        .when(F.col("l_partkey") % 50 == 9, F.lit(None))
        .otherwise(n)
    )
    role = (
        F.when(F.col("l_linenumber") == 7, F.lit("I"))
        .when(F.col("l_linenumber") == 6, F.lit(None))
        .when(F.col("l_returnflag") == "R", F.lit("PS"))
        .when(F.col("l_returnflag") == "A", F.lit("SS"))
        .otherwise(F.lit("C"))
    )
    t = F.col("p_type")
    route = (
        F.when(t == "ECONOMY", "Oral").when(t == "SMALL", "subcutaneous")
        .when(t == "MEDIUM", "Intramuscular").when(t == "LARGE", "By mouth")
        .when(t == "STANDARD", "TOPICAL")
    )
    return rows.select(
        F.col("l_orderkey").alias("PRIMARYID"),
        name.alias("DRUGNAME"),
        role.alias("ROLE_COD"),
        route.alias("ROUTE"),
    )


def reac(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return rows.select(
        F.col("l_orderkey").alias("PRIMARYID"),
        F.when(F.col("s_suppkey") % 29 != 0, F.col("n_name")).alias("PT"),
    ).distinct()


def dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound dimension; the properties are measured on part."""
    named = spark.createDataFrame(list(enumerate(DIM_NAMES)), "ordinal int, drug_name string")
    keys = F.array(*[F.lit(n) for n in DIM_NAMES])
    inside = F.filter(keys, lambda k: F.col("p_name").contains(F.lower(k)))
    tags = F.sort_array(F.collect_set(F.when(F.col("p_size") % 9 == 0, F.col("p_type"))))
    measured = (
        table(spark, sf_dir, "part")
        .select(F.explode(inside).alias("drug_name"), "p_brand", "p_type", "p_size", "p_retailprice")
        .groupBy("drug_name")
        .agg(
            F.max("p_retailprice").alias("mol_weight"),
            (F.count_distinct("p_brand") - F.lit(12.5)).alias("logP"),
            F.sum("p_size").cast("double").alias("TPSA"),
            F.min("p_size").alias("HBD"),
            F.count_distinct("p_type").cast("int").alias("HBA"),
            F.max("p_brand").alias("ATC"),
            F.array_join(tags, ";").alias("mechanism_tags"),
        )
    )
    joined = named.join(measured, "drug_name", "left")
    known = F.col("drug_name") != "Hot Bolt"
    numbers = ("mol_weight", "logP", "TPSA", "HBD", "HBA")
    return joined.withColumns({c: F.when(known, F.col(c)) for c in numbers})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score per event, with many ties."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
        (F.least(F.floor("value"), F.lit(100)) / F.lit(100.0)).alias("score"),
        (F.col("event_id") % 5).cast("int").alias("fold"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every event and label, hardly any ties."""
    names = F.array(*[F.lit(n) for n in EVENT_LABELS])
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "event_type", F.explode(names).alias("label")
    )
    y = (F.col("event_type") == F.col("label")).cast("int")
    digest = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.col("label")))
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return rows.select("id", "label", y.alias("y"), ((h + y * F.lit(0.3)) / F.lit(1.3)).alias("score"))


# --- the same in SQL -------------------------------------------------------


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_collapse(x: str) -> str:
    trimmed = sql_trim(f"upper({x})")
    return rf"regexp_replace({trimmed}, '\s+', ' ', 'g')"


def sql_std(x: str) -> str:
    return f"""regexp_replace({sql_collapse(x)}, '^"|"$', '', 'g')"""


def sql_fold(x: str) -> str:
    return f"translate(upper({sql_trim(x)}), '-_', '  ')"


def sql_key(x: str) -> str:
    return sql_fold(sql_fold(x))


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in p) + ")" for p in pairs)


CTES = {
    "demo": """SELECT o_orderkey AS PRIMARYID,
        CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey % 130 AS DOUBLE) END AS AGE,
        'YR' AS AGE_COD,
        CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS SEX,
        CASE WHEN o_orderkey % 11 = 0 THEN strftime(o_orderdate, '%Y%m')
             ELSE strftime(o_orderdate, '%Y%m%d') END AS FDA_DT
        FROM orders""",
    "demo_versions": "SELECT * FROM demo_reports WHERE PRIMARYID % 23 <> 0",
    "demo_reports": """SELECT o_orderkey AS PRIMARYID, 1 AS VERSION,
        CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey % 230 AS DOUBLE) END AS AGE_YR,
        CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' END AS SEX,
        CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_totalprice > 250000 AS INT) END AS SERIOUS,
        CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS I_F_COD,
        CASE WHEN o_orderkey % 19 <> 0 THEN 'C' || (o_custkey % 25) END AS COUNTRY,
        CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y%m%d') END AS EVENT_DT,
        CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y%m%d') END AS REPT_DT
        FROM orders
        UNION ALL
        SELECT o_orderkey, 2, 50.0, 'M', CASE WHEN o_orderkey % 8 = 0 THEN 1 END,
        'LATE', 'X', '20200101', '20200102'
        FROM orders WHERE o_orderkey % 4 = 0""",
    "drug": """SELECT l_orderkey AS PRIMARYID,
        CASE WHEN l_partkey % 10 = 0 THEN upper(p_name)
             WHEN l_partkey % 10 = 1 THEN replace(p_name, ' ', '-')
             WHEN l_partkey % 10 = 2 THEN '  ' || p_name || ' '
             WHEN l_partkey % 10 = 3 THEN '"' || p_name || '"'
             WHEN l_partkey % 10 = 4 THEN replace(p_name, ' ', '_')
             WHEN l_partkey % 10 = 5 THEN replace(p_name, ' ', '   ')
             WHEN l_partkey % 10 = 6 THEN p_name || ' XR'
             WHEN l_partkey % 10 = 7 THEN 'x ' || p_name
             WHEN l_partkey % 10 = 8 THEN replace(p_name, ' ', chr(9))
             WHEN l_partkey % 50 = 9 THEN NULL
             ELSE p_name END AS DRUGNAME,
        CASE WHEN l_linenumber = 7 THEN 'I' WHEN l_linenumber = 6 THEN NULL
             WHEN l_returnflag = 'R' THEN 'PS' WHEN l_returnflag = 'A' THEN 'SS'
             ELSE 'C' END AS ROLE_COD,
        CASE p_type WHEN 'ECONOMY' THEN 'Oral' WHEN 'SMALL' THEN 'subcutaneous'
             WHEN 'MEDIUM' THEN 'Intramuscular' WHEN 'LARGE' THEN 'By mouth'
             WHEN 'STANDARD' THEN 'TOPICAL' END AS ROUTE
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "reac": """SELECT DISTINCT l_orderkey AS PRIMARYID,
        CASE WHEN s_suppkey % 29 <> 0 THEN n_name END AS PT
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey""",
    "dim": f"""SELECT k.ordinal, k.drug_name,
        CASE WHEN k.drug_name <> 'Hot Bolt' THEN max(p_retailprice) END AS mol_weight,
        CASE WHEN k.drug_name <> 'Hot Bolt' THEN count(DISTINCT p_brand) - 12.5::DOUBLE END AS logP,
        CASE WHEN k.drug_name <> 'Hot Bolt' THEN CAST(sum(p_size) AS DOUBLE) END AS TPSA,
        CASE WHEN k.drug_name <> 'Hot Bolt' THEN min(p_size) END AS HBD,
        CASE WHEN k.drug_name <> 'Hot Bolt' THEN CAST(count(DISTINCT p_type) AS INT) END AS HBA,
        max(p_brand) AS ATC,
        coalesce(string_agg(DISTINCT p_type, ';' ORDER BY p_type) FILTER (WHERE p_size % 9 = 0), '') AS mechanism_tags
        FROM (VALUES {_values(enumerate(DIM_NAMES))}) k(ordinal, drug_name)
        LEFT JOIN part ON contains(p_name, lower(k.drug_name))
        GROUP BY k.ordinal, k.drug_name""",
    "syn": f"SELECT * FROM (VALUES {_values(SYNONYMS.items())}) s(token, target)",
    "brands": f"SELECT * FROM (VALUES {_values(BRANDS.items())}) b(brand, generic)",
    "named": f"""SELECT d.*, {sql_std('DRUGNAME')} AS DRUG_STD FROM drug d""",
    "generic": """SELECT n.*, coalesce(b.generic, n.DRUG_STD) AS GENERIC_STD
        FROM named n LEFT JOIN brands b ON n.DRUG_STD = b.brand""",
    "keyed": f"SELECT DISTINCT DRUGNAME, {sql_key('DRUGNAME')} AS k FROM drug",
    "cascade": rf"""SELECT k.DRUGNAME, coalesce(
        (SELECT drug_name FROM dim WHERE upper(drug_name) = k.k),
        (SELECT drug_name FROM dim WHERE upper(drug_name) = k.tok),
        (SELECT target FROM syn WHERE token = k.tok),
        (SELECT arg_min(drug_name, ordinal) FROM dim WHERE contains(k.k, upper(drug_name)))) AS drug_mapped
        FROM (SELECT DRUGNAME, k, regexp_extract(k, '^\s*(\S*)', 1) AS tok FROM keyed) k""",
    "mapped": """SELECT d.*, c.drug_mapped FROM drug d LEFT JOIN cascade c ON d.DRUGNAME = c.DRUGNAME""",
    "pairs": """SELECT m.PRIMARYID, m.drug_mapped, r.PT FROM mapped m JOIN reac r USING (PRIMARYID)
        WHERE m.ROLE_COD IN ('PS', 'SS', 'C') AND m.drug_mapped IS NOT NULL AND r.PT IS NOT NULL""",
    "dates": """SELECT *, CASE WHEN length(FDA_DT) = 8 THEN CAST(strptime(FDA_DT, '%Y%m%d') AS DATE) END AS d FROM demo""",
    "merged": """SELECT p.*, AGE, AGE_COD, SEX, year(d) AS YEAR, quarter(d) AS QTR
        FROM pairs p LEFT JOIN dates USING (PRIMARYID)""",
    "scored": """SELECT event_id AS id, CAST(event_type = 'purchase' AS INT) AS y,
        CAST(least(floor(value), 100) AS DOUBLE) / 100.0::DOUBLE AS score,
        CAST(event_id % 5 AS INT) AS fold FROM events""",
    "scored_labels": f"""SELECT event_id AS id, label, CAST(event_type = label AS INT) AS y,
        (('0x' || substr(md5(event_id || '|' || label), 1, 8))::BIGINT / 4294967296.0::DOUBLE
         + CAST(event_type = label AS INT) * 0.3::DOUBLE) / 1.3::DOUBLE AS score
        FROM events, (VALUES {_values((n,) for n in EVENT_LABELS)}) l(label)""",
}

_NEEDS = {
    "demo_versions": ("demo_reports",),
    "named": ("drug",),
    "generic": ("named", "brands"),
    "keyed": ("drug",),
    "cascade": ("keyed", "dim", "syn"),
    "mapped": ("drug", "cascade"),
    "pairs": ("mapped", "reac"),
    "dates": ("demo",),
    "merged": ("pairs", "dates"),
}


def with_ctes(names: str, body: str, **more: str) -> str:
    """SQL text with the named fragments (and what they need) in front."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]
    return f"WITH {', '.join(parts)} {body}"
