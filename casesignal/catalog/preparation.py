"""Feature profile, imputation, scaling, encoding, weights, splits, bits."""

from pyspark.sql import functions as F

from casesignal.catalog import adapters as a
from casesignal.catalog.registry import query
from casesignal.functions.bits import hashed_bits
from casesignal.operators import prep, splits
from casesignal.session import scratch_path
from casesignal.sources.contract import fill_nulls
from casesignal.sources.tables import cached_table


def _people(spark, sf):
    return a.demo_reports(spark, sf).withColumn("NOTHING", F.lit(None).cast("double"))


@query(
    "feature_profile",
    a.with_ctes(
        "demo_reports",
        """SELECT 'AGE_YR' AS "column", count(AGE_YR) AS non_null, CAST(count(DISTINCT AGE_YR) > 1 AS BIGINT) AS varied,
            0::BIGINT AS "binary" FROM demo_reports
        UNION ALL SELECT 'SERIOUS', count(SERIOUS), CAST(count(DISTINCT SERIOUS) > 1 AS BIGINT), 1 FROM demo_reports
        UNION ALL SELECT 'SEX', count(SEX), CAST(count(DISTINCT SEX) > 1 AS BIGINT), 0 FROM demo_reports
        UNION ALL SELECT 'NOTHING', 0, 0, 0
        UNION ALL SELECT 'ODD', count(*), 1, 0 FROM demo_reports""",
    ),
)
def feature_profile(spark, sf):
    """Which features are all-null, one-valued or 0/1."""
    key = F.col("PRIMARYID")
    odd = F.when(key % 3 == 0, F.lit(float("nan"))).when(key % 3 == 1, 1e30).otherwise(1.0)
    return prep.profile(_people(spark, sf).withColumn("ODD", odd), ["AGE_YR", "SERIOUS", "SEX", "NOTHING", "ODD"])


@query(
    "usable_features",
    a.with_ctes(
        "demo_reports",
        """SELECT feature, kind FROM (
            SELECT 'AGE_YR' AS feature, 'numeric' AS kind, count(AGE_YR) > 0 AS ok FROM demo_reports
            UNION ALL SELECT 'SERIOUS', 'numeric', count(SERIOUS) > 0 FROM demo_reports
            UNION ALL SELECT 'NOTHING', 'numeric', count(NULL) > 0 FROM demo_reports
            UNION ALL SELECT 'SEX', 'categorical', count(DISTINCT SEX) > 1 FROM demo_reports
            UNION ALL SELECT 'ONE', 'categorical', count(DISTINCT 'x') > 1 FROM demo_reports) WHERE ok""",
    ),
)
def usable_features(spark, sf):
    """All-null numbers and one-valued categories are dropped."""
    rows = _people(spark, sf).withColumn("ONE", F.lit("x"))
    numeric, categorical = prep.usable_features(rows, ["AGE_YR", "SERIOUS", "NOTHING"], ["SEX", "ONE"])
    found = [(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical]
    return spark.createDataFrame(found, "feature string, kind string")


@query(
    "impute_median",
    a.with_ctes(
        "demo_reports",
        """SELECT PRIMARYID, CAST(VERSION AS BIGINT) AS VERSION, round(coalesce(AGE_YR, m.age), 6) AS AGE_YR,
        round(coalesce(CAST(SERIOUS AS DOUBLE), m.mid), 6) AS SERIOUS FROM demo_reports,
        (SELECT median(AGE_YR) AS age, median(SERIOUS) AS mid FROM demo_reports) m""",
    ),
)
def impute_median(spark, sf):
    rows = a.demo_reports(spark, sf).select("PRIMARYID", "VERSION", "AGE_YR", "SERIOUS")
    return prep.impute_median(rows, ["AGE_YR", "SERIOUS"])


@query(
    "median_of_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(median({c}), 6) AS median FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def median_of_columns(spark, sf):
    """Exact medians of large columns."""
    return prep.medians(a.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "impute_mode",
    a.with_ctes(
        "demo_reports",
        """SELECT PRIMARYID, CAST(VERSION AS BIGINT) AS VERSION,
        coalesce(SEX, (SELECT SEX FROM demo_reports WHERE SEX IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, SEX LIMIT 1)) AS SEX,
        coalesce(COUNTRY, (SELECT COUNTRY FROM demo_reports WHERE COUNTRY IS NOT NULL
            GROUP BY 1 ORDER BY count(*) DESC, COUNTRY LIMIT 1)) AS COUNTRY FROM demo_reports""",
    ),
)
def impute_mode(spark, sf):
    """Commonest value, the smallest among equals."""
    rows = a.demo_reports(spark, sf).select("PRIMARYID", "VERSION", "SEX", "COUNTRY")
    return prep.impute(rows, prep.as_dict(prep.most_frequent(rows, ["SEX", "COUNTRY"])))


@query(
    "fill_defaults",
    a.with_ctes(
        "demo_reports",
        """SELECT PRIMARYID, CAST(VERSION AS BIGINT) AS VERSION, CAST(coalesce(SERIOUS, 0) AS BIGINT) AS SERIOUS,
        coalesce(COUNTRY, 'UNK') AS COUNTRY FROM demo_reports""",
    ),
)
def fill_defaults(spark, sf):
    rows = a.demo_reports(spark, sf).select("PRIMARYID", "VERSION", "SERIOUS", "COUNTRY")
    return fill_nulls(rows, {"SERIOUS": 0, "COUNTRY": "UNK"})


@query(
    "scale_std",
    """SELECT o_orderkey, round(o_totalprice / s, 6) AS o_totalprice FROM orders,
    (SELECT stddev_pop(o_totalprice) AS s FROM orders)""",
)
def scale_std(spark, sf):
    """Divide by the population deviation, no centring."""
    rows = a.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return prep.scale(rows, ["o_totalprice"], center=False)


@query(
    "standardise",
    """SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM orders,
    (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)""",
)
def standardise(spark, sf):
    rows = a.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return prep.scale(rows, ["o_totalprice"])


@query(
    "one_hot",
    "SELECT o_orderkey, o_orderstatus, "
    + ", ".join(f"CAST(o_orderstatus = '{s}' AS BIGINT) AS o_orderstatus_{s}" for s in "FOP")
    + " FROM orders",
)
def one_hot(spark, sf):
    return prep.one_hot(a.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query(
    "one_hot_wide",
    """SELECT o_orderkey, o_custkey, o_custkey_index FROM orders JOIN (
        SELECT o_custkey AS c, row_number() OVER (ORDER BY o_custkey) - 1 AS o_custkey_index FROM (SELECT DISTINCT o_custkey FROM orders)
    ) ON o_custkey = c""",
)
def one_hot_wide(spark, sf):
    """A category of any number of values, as the place of the 1 in each row."""
    return prep.one_hot_long(a.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query(
    "class_weights",
    a.with_ctes(
        "scored",
        """SELECT CAST(y AS BIGINT) AS y, n, round(t / (2.0::DOUBLE * n), 6) AS weight FROM
        (SELECT y, count(*) AS n FROM scored GROUP BY 1), (SELECT count(*) AS t FROM scored)""",
    ),
)
def class_weights(spark, sf):
    return prep.class_weights(a.scored(spark, sf), "y")


@query(
    "positive_weight",
    a.with_ctes(
        "scored",
        """SELECT CAST(fold AS BIGINT) AS fold, round(sum(1 - y) / greatest(sum(y), 1), 6) AS pos_weight
        FROM scored GROUP BY 1""",
    ),
)
def positive_weight(spark, sf):
    return prep.positive_weight(a.scored(spark, sf), "y", ["fold"])


def _md5(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


@query(
    "hashed_bits",
    f"""SELECT doc_id, len(bits)::BIGINT AS n_bits, CAST(list_sum(bits) AS BIGINT) AS bit_sum FROM
    (SELECT doc_id, list_distinct([{_md5('c[i] || c[i + 1] || c[i + 2]')} % 1024
        for i in range(1, len(c) - 1)]) AS bits FROM (SELECT doc_id, string_split(text, '') AS c FROM documents))""",
)
def hashed_bits_of_text(spark, sf):
    """Trigram bits of whole documents."""
    bits = hashed_bits(F.col("text"), 1024, 3, "md5")
    rows = a.table(spark, sf, "documents").select("doc_id", bits.alias("bits"))
    return rows.select(
        "doc_id",
        F.size("bits").alias("n_bits"),
        F.aggregate("bits", F.lit(0).cast("long"), lambda s, b: s + b).alias("bit_sum"),
    )


@query(
    "bits_by_value",
    f"""SELECT p_partkey, p_name, len(bits)::BIGINT AS n_bits FROM
    (SELECT p_partkey, p_name, list_distinct([{_md5('substr(p_name, i, 3)')} % 256
        for i in range(1, length(p_name) - 1)]) AS bits FROM part)""",
)
def bits_by_value(spark, sf):
    """Bits of a repeated text column, computed once per distinct value."""
    rows = a.table(spark, sf, "part").select("p_partkey", "p_name")
    bits = prep.bits_by_value(rows, "p_name", nbits=256, hash_name="md5")
    return bits.select("p_partkey", "p_name", F.size("bits").alias("n_bits"))


@query(
    "cached_dimension",
    "SELECT DISTINCT p_name, CAST(length(p_name) AS BIGINT) AS n_chars FROM part",
)
def cached_dimension(spark, sf):
    """A derived table stored under the content key of its source."""
    names = a.table(spark, sf, "part").select("p_name").distinct()
    root = scratch_path(spark, "cache")

    def build(df):
        return df.select("p_name", F.length("p_name").alias("n_chars"))

    cached_table(names, "p_name", root, "lengths", build)
    return cached_table(names, "p_name", root, "lengths", build)


_H = "md5(event_id || '|42')"


@query(
    "holdout",
    f"""SELECT event_id, CAST({_md5("event_id || '|42'")} / 4294967296.0::DOUBLE < 0.2 AS BIGINT) AS is_test FROM events""",
)
def holdout(spark, sf):
    return splits.holdout(a.table(spark, sf, "events").select("event_id"), "event_id", 42)


@query(
    "stratified_holdout",
    f"""SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY {_H}, event_id)
    <= ceil(0.2 * count(*) OVER (PARTITION BY event_type)) AS BIGINT) AS is_test FROM events""",
)
def stratified_holdout(spark, sf):
    rows = a.table(spark, sf, "events").select("event_id", "event_type")
    return splits.stratified_holdout(rows, "event_id", ["event_type"], 42)


@query(
    "stratified_folds",
    f"""SELECT event_id, event_type, CAST(CAST(rn > (n + 4) // 5 AS INT) + CAST(rn > (2 * n + 4) // 5 AS INT)
    + CAST(rn > (3 * n + 4) // 5 AS INT) + CAST(rn > (4 * n + 4) // 5 AS INT) AS BIGINT) AS fold FROM
    (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_H}, event_id) AS rn,
     count(*) OVER (PARTITION BY event_type) AS n FROM events)""",
)
def stratified_folds(spark, sf):
    rows = a.table(spark, sf, "events").select("event_id", "event_type")
    return splits.stratified_folds(rows, "event_id", ["event_type"], 42)


_HV = "md5(event_id || '|42-val')"


@query(
    "nested_split",
    f"""WITH o AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_H}, event_id)
        <= ceil(0.2 * count(*) OVER (PARTITION BY event_type)) AS t FROM events),
    i AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY {_HV}, event_id)
        <= ceil(0.2 * count(*) OVER (PARTITION BY event_type)) AS v FROM o WHERE NOT t)
    SELECT o.event_id, event_type, CASE WHEN t THEN 'test' WHEN v THEN 'val' ELSE 'train' END AS part
    FROM o LEFT JOIN i USING (event_id)""",
)
def nested_split(spark, sf):
    """Test, validation and training rows, stratified."""
    rows = a.table(spark, sf, "events").select("event_id", "event_type")
    return splits.nested(rows, "event_id", 42, ["event_type"])
