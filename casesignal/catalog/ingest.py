"""Text, CSV and parquet in and out, on files written from the test tables."""

from pyspark.sql import functions as F

from casesignal.catalog import adapters as a
from casesignal.catalog.registry import query
from casesignal.session import scratch_path
from casesignal.sources import tables, text


def _write_text(df, path):
    writer = df.write.option("header", "true").option("sep", "$").option("quote", '"')
    writer.option("escape", '"').option("encoding", "ISO-8859-1").option("nullValue", "NA").csv(path)


def _raw_text(spark, sf) -> str:
    """Two folders of delimited files whose headers differ in order and case."""
    root = scratch_path(spark, "text")
    rows = a.demo(spark, sf).select(
        F.col("PRIMARYID").cast("string").alias("primaryid"),
        F.concat(F.lit("c"), F.col("PRIMARYID").cast("string")).alias("caseid"),
        F.col("AGE").cast("string").alias("age"),
        F.col("SEX").alias("sex"),
        F.col("FDA_DT").alias("fda_dt"),
    )
    number = F.col("primaryid").cast("long")
    even, odd = rows.where(number % 2 == 0), rows.where(number % 2 == 1)
    # Every tenth row twice, and one keyless row for each; a column is missing.
    twice = even.unionByName(even.where(number % 10 == 0)).unionByName(
        even.where(number % 10 == 0).withColumn("primaryid", F.lit("NULL"))
    )
    _write_text(twice, f"{root}/q1")
    other = odd.select(
        F.col("fda_dt").alias("FDA_DT"), F.lit('say "x"').alias("NOTE"), F.col("primaryid").alias("PrimaryId"),
        F.col("sex").alias("SEX"), F.col("caseid").alias("CASEID"),
    )
    _write_text(other, f"{root}/deep/q2")
    return root


@query(
    "text_ingest",
    a.with_ctes(
        "demo",
        """SELECT CAST(PRIMARYID AS VARCHAR) AS PRIMARYID, 'c' || PRIMARYID AS CASEID,
        CASE WHEN PRIMARYID % 2 = 0 THEN CAST(AGE AS VARCHAR) END AS AGE, CAST(NULL AS VARCHAR) AS AGE_COD, SEX, FDA_DT
        FROM demo""",
    ),
)
def text_ingest(spark, sf):
    """Discovery, header drift, union, missing values, keys, duplicates."""
    root = _raw_text(spark, sf)
    return text.read_text_table(spark, root, text.CASE_TABLES["DEMO"], "*.csv").rows


@query(
    "text_ingest_no_files",
    "SELECT 'found' AS part, CAST(r_regionkey AS VARCHAR) AS PRIMARYID, r_name AS PT FROM region",
)
def text_ingest_no_files(spark, sf):
    """One pattern matches files written from region, one matches none: an empty table."""
    root = scratch_path(spark, "regions")
    rows = a.table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("primaryid"), F.col("r_name").alias("pt"))
    _write_text(rows, f"{root}/REAC")
    read = lambda pattern: text.read_text_table(spark, root, text.CASE_TABLES["REAC"], pattern).rows
    return read("*.csv").select(F.lit("found").alias("part"), "*").unionByName(read("no-such-file*").select(F.lit("none").alias("part"), "*"))


@query(
    "text_rejected",
    "SELECT CAST(r_regionkey AS VARCHAR) AS first_field, count(*) AS n FROM region GROUP BY 1",
)
def text_rejected(spark, sf):
    """Rows with more fields than their header are set aside with their text."""
    root = scratch_path(spark, "rejected")
    rows = a.table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("k"), "r_name")
    head = spark.range(1).select(F.lit("primaryid$pt").alias("value"))
    lines = F.explode(F.array(F.concat_ws("$", "k", "r_name"), F.concat_ws("$", "k", "r_name", F.lit("surplus"))))
    body = rows.select(lines.alias("value"))
    head.unionByName(body).coalesce(1).write.text(f"{root}/REAC")
    bad = text.read_text_table(spark, root, text.CASE_TABLES["REAC"], "*.txt").rejected
    return bad.groupBy(F.substring_index("line", "$", 1).alias("first_field")).agg(F.count("*").alias("n"))


@query(
    "csv_roundtrip",
    r"""SELECT c_custkey, c_name || '"\' || c_mktsegment || ', x' AS name, round(c_acctbal, 6) AS c_acctbal FROM customer""",
)
def csv_roundtrip(spark, sf):
    """Typed CSV written and read; names hold quotes, commas, backslashes."""
    path = scratch_path(spark, "csv")
    rows = a.table(spark, sf, "customer").select(
        "c_custkey", F.concat("c_name", F.lit('"\\'), "c_mktsegment", F.lit(", x")).alias("name"), "c_acctbal"
    )
    tables.write_csv(rows, path)
    return tables.read_csv(spark, path, "c_custkey long, name string, c_acctbal double")


@query(
    "parquet_roundtrip",
    a.with_ctes("dates", "SELECT PRIMARYID, AGE, SEX, CAST(year(d) AS BIGINT) AS YEAR FROM dates"),
)
def parquet_roundtrip(spark, sf):
    """Parquet written by year and read back."""
    from casesignal.functions.scalars import parse_date

    path = scratch_path(spark, "parquet")
    rows = a.demo(spark, sf).select(
        "PRIMARYID", "AGE", "SEX", F.year(parse_date(F.col("FDA_DT"))).alias("YEAR")
    )
    tables.write_parquet(rows, path, partition_by=["YEAR"])
    return tables.read_parquet(spark, path)
