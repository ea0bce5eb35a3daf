"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that end a word, and a word, in the contracts' notation.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str | T.StructType
) -> DataFrame:
    """Map each Arrow batch of ``df`` to columns given as arrays or lists.

    ``fn`` sees one batch at a time, so a task holds one batch in memory.
    """
    return arrow_parts(df, lambda batch: iter([fn(batch)]), schema)


def arrow_parts(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, object]]], schema: str | T.StructType
) -> DataFrame:
    """``arrow_map`` whose ``fn`` yields its columns in parts; each is sent on before the next is made."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in fn(batch):
                    out = to_batch(part, target)
                    if out.num_rows:
                        yield out

    return df.mapInArrow(run, fields)


def arrow_schema(fields: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def to_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        got = columns[field.name]
        if isinstance(got, pa.ChunkedArray):
            got = got.combine_chunks()
        if isinstance(got, pa.Array):
            arrays.append(got if got.type == field.type else got.cast(field.type))
        else:
            arrays.append(pa.array(got, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null gives b''."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Words between spaces and \\t..\\r, with A-Z in lower case."""
    return text.lower().split()


def word_count(col: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")
