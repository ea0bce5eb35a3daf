"""Delimited case-report text.

Many files with one prefix form one table. One job looks at all files: it finds
each header and whether a quoted field holds a line break. Files of equal
headers are then read in one scan: a single scan over mixed headers would bind
columns by position and swap them silently. Files whose lines all close their
quotes are split; the others are read whole, a task each. A file that cannot be
read is set aside, and the others are read without it.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.functions.text import null_if_na
from casesignal.functions.vocab import NA_TOKENS

_BAD = "_corrupt_record"
_REJECTED = "file string, line string, error string"
# A byte order mark, as such and as Latin-1 reads it.
_MARKS = ("\ufeff", "\u00ef\u00bb\u00bf")

# The columns kept of each raw table; the first is the key.
CASE_TABLES = {
    "DEMO": ("PRIMARYID", "CASEID", "AGE", "AGE_COD", "SEX", "FDA_DT"),
    "DRUG": ("PRIMARYID", "DRUGNAME", "ROLE_COD"),
    "REAC": ("PRIMARYID", "PT"),
}


@dataclass(frozen=True)
class TextTable:
    """Clean rows; and the raw lines that had too many fields, with their file,
    and the files that could not be read, with the error instead of a line."""

    rows: DataFrame
    rejected: DataFrame


def file_pattern(prefix: str) -> str:
    return f"{prefix}*.[tT][xX][tT]"


def list_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Paths below root; only the listing is read, no file content."""
    try:
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern)
            .load(root)
            .select("path")
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r["path"] for r in found.collect())


@dataclass(frozen=True)
class Look:
    """What is known of a file before it is read; ``error`` if it cannot be."""

    path: str
    header: tuple[str, ...] = ()
    whole: bool = False
    error: str | None = None


def look_at(spark: SparkSession, paths: Sequence[str], sep: str, encoding: str) -> list[Look]:
    """Header and need to be read whole of each file that has a line, in one job.

    If the job fails, halves are tried until the unreadable files stand alone.
    A header is the first line that is not blank.
    """
    if not paths:
        return []
    # Text is read as UTF-8; a malformed line must not end the look.
    utf8 = encoding.lower().replace("-", "") == "utf8"
    line = F.col("value") if utf8 else F.decode(F.col("value").cast("binary"), encoding)
    lines = (
        spark.read.text(list(paths))
        .select(
            F.col("_metadata.file_path").alias("path"),
            line.alias("line"),
            (F.col("_metadata.file_block_start") == 0).alias("top"),
        )
        .withColumn("at", F.monotonically_increasing_id())
    )
    odd = F.length("line") - F.length(F.replace("line", F.lit('"')))
    header = F.when(F.col("top") & (F.trim("line") != ""), F.col("line"))
    looked = lines.groupBy("path").agg(
        F.min_by(header, F.when(header.isNotNull(), F.col("at"))).alias("header"),
        F.max(odd % 2 == 1).alias("whole"),
    )
    try:
        found = looked.collect()
    except (PySparkException, Py4JJavaError) as e:
        if len(paths) == 1:
            said = str(e.java_exception if isinstance(e, Py4JJavaError) else e)
            return [Look(paths[0], error=said.strip().splitlines()[0])]
        half = len(paths) // 2
        return look_at(spark, paths[:half], sep, encoding) + look_at(spark, paths[half:], sep, encoding)
    return sorted(
        (Look(r["path"], _names(r["header"], sep), r["whole"]) for r in found if r["header"] is not None),
        key=lambda f: f.path,
    )


def _names(header: str, sep: str) -> tuple[str, ...]:
    for mark in _MARKS:
        header = header.removeprefix(mark)
    return tuple(n.strip().upper() for n in next(csv.reader([header], delimiter=sep)))


def read_text_table(
    spark: SparkSession,
    root: str,
    columns: Sequence[str],
    pattern: str,
    sep: str = "$",
    encoding: str = "ISO-8859-1",
    na_tokens: Sequence[str] = NA_TOKENS,
) -> TextTable:
    """Union of all matching files, as distinct all-text rows.

    Headers are upper-cased; wanted columns that a file lacks are null; texts
    that mean "missing" become null; rows without a key (the first wanted
    column) are dropped. Of columns with one name the first counts. Without any
    file both tables are empty.
    """
    wanted = list(columns)
    empty = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in wanted]))
    files = look_at(spark, list_files(spark, root, pattern), sep, encoding)
    failed = [(f.path, None, f.error) for f in files if f.error is not None]

    alike: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for f in files:
        if f.error is None:
            alike.setdefault((f.header, f.whole), []).append(f.path)
    good, bad = [], [spark.createDataFrame(failed, _REJECTED)]
    for (header, whole), paths in alike.items():
        rows, rejected = _scan(spark, header, paths, wanted, sep, encoding, whole)
        good.append(rows)
        bad.append(rejected)

    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), good, empty)
    clean = union.select(*[null_if_na(F.col(c), tuple(na_tokens)).alias(c) for c in wanted])
    return TextTable(
        clean.dropna(subset=[wanted[0]]).dropDuplicates(),
        reduce(DataFrame.unionByName, bad),
    )


def _scan(
    spark: SparkSession, names: Sequence[str], paths: list[str], wanted: list[str], sep: str, encoding: str, whole: bool
) -> tuple[DataFrame, DataFrame]:
    taken = [f"_c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*taken, _BAD]])
    raw = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", "true")
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", whole)
        # A row is checked against its whole header whatever is selected.
        .option("columnPruning", "false")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .csv(paths)
        .withColumn("__file", F.col("_metadata.file_path"))
    )
    # Short rows are padded with nulls; only surplus fields spoil a row.
    # The reader refuses queries on the raw line alone, so an empty piece of a
    # parsed field goes with it.
    line = F.concat(F.col(_BAD), F.substring(F.coalesce(F.col(taken[0]), F.lit("")), 1, 0))
    bare = F.regexp_replace(line, '"[^"]*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep))) + 1
    too_long = F.coalesce(fields > len(names), F.lit(False))
    keep = [F.col(taken[names.index(c)]).alias(c) for c in wanted if c in names]
    rejected = raw.where(too_long).select(
        F.col("__file").alias("file"), F.col(_BAD).alias("line"), F.lit(None).cast("string").alias("error")
    )
    return raw.where(~too_long).select(*keep), rejected


def read_case_table(spark: SparkSession, root: str, prefix: str, columns: Sequence[str] | None = None) -> TextTable:
    """One of the raw tables by its file prefix (DEMO, DRUG, REAC)."""
    return read_text_table(spark, root, columns or CASE_TABLES[prefix], file_pattern(prefix))
