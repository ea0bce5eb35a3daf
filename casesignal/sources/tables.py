"""Parquet and CSV tables, cached derived tables, persisted models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schema of the compound dimension file.
COMPOUND_SCHEMA = T.StructType(
    [
        T.StructField("drug_name", T.StringType()),
        T.StructField("smiles", T.StringType()),
        T.StructField("mol_weight", T.DoubleType()),
        T.StructField("logP", T.DoubleType()),
        T.StructField("TPSA", T.DoubleType()),
        T.StructField("HBD", T.IntegerType()),
        T.StructField("HBA", T.IntegerType()),
        T.StructField("ATC", T.StringType()),
        T.StructField("mechanism_tags", T.StringType()),
    ]
)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed CSV; quotes are doubled, not escaped by a backslash."""
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", "false")
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def content_key(df: DataFrame, column: str) -> str:
    """Key of the distinct values of a column, whatever their order.

    Only three numbers leave the executors: the count, a sum and an xor of the
    value hashes. Null counts as empty text.
    """
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("v")).distinct()
    hashed = F.xxhash64("v")
    row = values.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hashed.cast("decimal(38,0)")).alias("s"),
        F.bit_xor(hashed).alias("x"),
        F.bit_xor(F.conv(F.substring(F.md5("v"), 1, 15), 16, 10).cast("long")).alias("m"),
    ).first()
    return "-".join(f"{int(row[k] or 0) % 2**64:x}" for k in "nsxm")


def table_exists(spark: SparkSession, path: str) -> bool:
    """True for a fully written parquet table (its schema can be read)."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
        spark.read.text(f"{path}/_SUCCESS")
    except (AnalysisException, Py4JJavaError):
        return False
    return True


def cached_table(
    source: DataFrame, column: str, root: str, label: str, build: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Derived table stored under the content key of one column of the source.

    Built and written on the first use; read on later uses with equal content.
    """
    path = f"{root.rstrip('/')}/{label}_{content_key(source, column)}.parquet"
    spark = source.sparkSession
    if not table_exists(spark, path):
        write_parquet(build(source), path, mode="overwrite")
    return spark.read.parquet(path)


def save_model(model: MLWritable, path: str) -> None:
    """Model or pipeline with its preprocessing, replacing an older one."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
