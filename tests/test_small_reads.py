"""A task after a shuffle reads little, however many cores there are."""

from pyspark.sql import functions as F

from casesignal.catalog.registry import query
from casesignal.catalog import registry


def test_tasks_after_a_shuffle_read_little(spark, monkeypatch):
    """Some 64 MB after a join on eight cores: far more than eight tasks."""
    monkeypatch.setattr(registry, "_QUERIES", {})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:

        @query("probe")
        def probe(spark, _):
            left = spark.range(4_000_000).select(F.xxhash64("id").alias("k"))
            right = spark.range(4_000_000).select(F.xxhash64("id").alias("k"), F.rand(1).alias("v"))
            return left.hint("merge").join(right.hint("merge"), "k").select(F.spark_partition_id().alias("task")).groupBy("task").count()

        assert registry.queries()["probe"](spark, "").count() > 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
