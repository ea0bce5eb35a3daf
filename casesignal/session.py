"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key also where the join feeds an aggregate on the same key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Joins of cases multiply rows: what a task reads is small, so that what it makes
#: of it fits its memory however large the tables are.
_SMALL_READS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options that the plans count on."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def prepare_joins(spark: SparkSession) -> SparkSession:
    """``prepare``, and small reads after a shuffle."""
    prepare(spark)
    for key, value in _SMALL_READS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local master gets a temporary folder of its own; a cluster without
    the setting is an error, since executors would not share that folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir()


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="casesignal-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a derived table once to the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and gives later joins the
    table's true size. Used where several passes need one aggregate, so that
    the input is scanned once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
