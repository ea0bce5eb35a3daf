"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from casesignal.catalog import adapters as a
from casesignal.catalog.registry import query
from casesignal.functions import scalars, text
from casesignal.functions.vocab import CASE_AGE_BINS, CONTEXT_AGE_BINS, ORAL_ROUTE, SUBCUTANEOUS_ROUTE
from casesignal.operators import prep


@query(
    "date_parts",
    a.with_ctes(
        "dates",
        """SELECT PRIMARYID, CAST(d AS VARCHAR) AS report_date, CAST(year(d) AS BIGINT) AS YEAR,
        CAST(quarter(d) AS BIGINT) AS QTR FROM dates""",
    ),
)
def date_parts(spark, sf):
    """Texts that are no full date give null."""
    date = scalars.parse_date(F.col("FDA_DT"))
    return a.demo(spark, sf).select(
        "PRIMARYID",
        date.alias("report_date"),
        scalars.year_of(date).alias("YEAR"),
        scalars.quarter_of(date).alias("QTR"),
    )


@query(
    "age_bins",
    a.with_ctes(
        "demo_reports",
        """SELECT PRIMARYID, CAST(VERSION AS BIGINT) AS VERSION,
        CASE WHEN AGE_YR > -1 AND AGE_YR <= 39 THEN 'age_<40' WHEN AGE_YR > 39 AND AGE_YR <= 64 THEN 'age_40_64'
             WHEN AGE_YR > 64 AND AGE_YR <= 200 THEN 'age_65p' END AS wide,
        CASE WHEN AGE_YR > -1 AND AGE_YR <= 18 THEN '<18' WHEN AGE_YR > 18 AND AGE_YR <= 40 THEN '18-40'
             WHEN AGE_YR > 40 AND AGE_YR <= 65 THEN '40-65' WHEN AGE_YR > 65 AND AGE_YR <= 120 THEN '65+' END AS fine
        FROM demo_reports""",
    ),
)
def age_bins(spark, sf):
    return a.demo_reports(spark, sf).select(
        "PRIMARYID",
        "VERSION",
        scalars.cut(F.col("AGE_YR"), *CONTEXT_AGE_BINS).alias("wide"),
        scalars.cut(F.col("AGE_YR"), *CASE_AGE_BINS).alias("fine"),
    )


@query(
    "value_maps",
    a.with_ctes(
        "demo_reports",
        """SELECT PRIMARYID, CAST(VERSION AS BIGINT) AS VERSION, coalesce(SEX, 'UNK') AS sex,
        CAST(AGE_YR IS NULL AS BIGINT) AS age_missing, CAST(coalesce(SERIOUS, 0) AS BIGINT) AS serious,
        coalesce(I_F_COD, 'UNK') AS reporter, coalesce(EVENT_DT, REPT_DT) AS any_date
        FROM demo_reports""",
    ),
)
def value_maps(spark, sf):
    """Mapped values, missing indicators, defaults and fallbacks."""
    return a.demo_reports(spark, sf).select(
        "PRIMARYID",
        "VERSION",
        scalars.known_sex(F.col("SEX")).alias("sex"),
        scalars.missing_flag(F.col("AGE_YR")).alias("age_missing"),
        F.coalesce("SERIOUS", F.lit(0)).cast("int").alias("serious"),
        F.coalesce("I_F_COD", F.lit("UNK")).alias("reporter"),
        F.coalesce("EVENT_DT", "REPT_DT").alias("any_date"),
    )


@query(
    "route_flags",
    a.with_ctes(
        "drug",
        """SELECT ROUTE, ROLE_COD,
        CAST(regexp_matches(coalesce(upper(ROUTE), ''), 'ORAL|PO|BY MOUTH') AS BIGINT) AS is_oral,
        CAST(regexp_matches(coalesce(upper(ROUTE), ''), 'SUBCUTANEOUS|SC|SUBCUT') AS BIGINT) AS is_sc,
        CAST(coalesce(upper(ROLE_COD) = 'PS', false) AS BIGINT) AS is_ps, count(*) AS n
        FROM drug GROUP BY ALL""",
    ),
)
def route_flags(spark, sf):
    """INTRAMUSCULAR holds SC and is flagged; a missing route is 0."""
    flagged = a.drug(spark, sf).select(
        "ROUTE",
        "ROLE_COD",
        scalars.pattern_flag(F.col("ROUTE"), ORAL_ROUTE).alias("is_oral"),
        scalars.pattern_flag(F.col("ROUTE"), SUBCUTANEOUS_ROUTE).alias("is_sc"),
        scalars.equals_flag(F.col("ROLE_COD"), "PS").alias("is_ps"),
    )
    return flagged.groupBy(*flagged.columns).agg(F.count(F.lit(1)).alias("n"))


_TAGGED = "p_type || ';' || p_brand || ' , |' || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END"


@query(
    "split_tags",
    f"""SELECT p_partkey, trim(tag) AS tag, count(*) AS n FROM
    (SELECT p_partkey, unnest(regexp_split_to_array({_TAGGED}, '[;,|]+')) AS tag FROM part)
    WHERE trim(tag) <> '' GROUP BY ALL""",
)
def split_tags(spark, sf):
    """Tags cut at runs of separators, trimmed, without empty ones."""
    tagged = F.concat(
        "p_type", F.lit(";"), "p_brand", F.lit(" , |"),
        F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_name")),
    )
    rows = a.table(spark, sf, "part").select("p_partkey", F.explode(text.split_tags(tagged)).alias("tag"))
    return rows.groupBy("p_partkey", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ratios_and_logs",
    """SELECT l_orderkey, CAST(big >= 3 AS BIGINT) AS ge3,
    round(big / nullif(small, 0), 6) AS ratio, round(ln(1 + big), 6) AS ln_big,
    round(least(greatest(top, 10.0::DOUBLE), 40.0::DOUBLE), 6) AS clipped, round(top - low, 6) AS span
    FROM (SELECT l_orderkey, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS big,
          CAST(sum(CASE WHEN l_quantity <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS small,
          max(l_quantity) AS top, min(l_quantity) AS low FROM lineitem GROUP BY 1)""",
)
def ratios_and_logs(spark, sf):
    counts = a.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum((F.col("l_quantity") > 25).cast("long")).alias("big"),
        F.sum((F.col("l_quantity") <= 10).cast("long")).alias("small"),
        F.max("l_quantity").alias("top"),
        F.min("l_quantity").alias("low"),
    )
    return counts.select(
        "l_orderkey",
        scalars.at_least(F.col("big"), 3).alias("ge3"),
        scalars.ratio(F.col("big"), F.col("small")).alias("ratio"),
        F.log1p("big").alias("ln_big"),
        scalars.clip(F.col("top"), 10, 40).alias("clipped"),
        (F.col("top") - F.col("low")).alias("span"),
    )


_MIXED = """CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN ' ' || o_custkey || '.5 '
    WHEN 2 THEN '-' || o_custkey || 'e1' WHEN 3 THEN o_custkey || 'D' WHEN 4 THEN 'NaN' END"""


def _mixed():
    key = F.col("o_orderkey") % 6
    cust = F.col("o_custkey").cast("string")
    return (
        F.when(key == 0, cust)
        .when(key == 1, F.concat(F.lit(" "), cust, F.lit(".5 ")))
        .when(key == 2, F.concat(F.lit("-"), cust, F.lit("e1")))
        .when(key == 3, F.concat(cust, F.lit("D")))
        .when(key == 4, F.lit("NaN"))
    )


@query(
    "numeric_cast",
    rf"""SELECT o_orderkey, m AS raw, CASE WHEN regexp_matches(m, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')
    THEN round(CAST(trim(m) AS DOUBLE), 6) END AS number FROM (SELECT o_orderkey, {_MIXED} AS m FROM orders)""",
)
def numeric_cast(spark, sf):
    """Numbers out of text; suffixes and NaN give null."""
    rows = a.table(spark, sf, "orders").select("o_orderkey", _mixed().alias("raw"))
    return rows.withColumn("number", scalars.to_number(F.col("raw")))


@query(
    "safe_numeric",
    f"""SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS whole, {_MIXED} AS mixed FROM orders""",
)
def safe_numeric(spark, sf):
    """Only the column whose every value parses becomes numeric."""
    rows = a.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("whole"), _mixed().alias("mixed")
    )
    return prep.safe_numeric(rows, ["whole", "mixed"])
