"""Quality classifier: boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows; every row is scored
in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.llm.boosting import Trees, fit
from casesignal.llm.common import arrow_map, texts_of
from casesignal.llm.doc_stats import FEATURES, features

#: Labelled rows that a model is fitted on, at most: those of the least hashes.
SAMPLE = 40_000


def held_out(id_col: Column, parts: int = 4, part: int = 2) -> Column:
    """True for ids whose crc32, as text, leaves ``part``; null ids are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> DataFrame:
    """``y`` and the features ``x`` of up to ``rows`` labelled documents.

    Labels of held-out documents are not read. Where rows share an id, the
    smallest label and the smallest features count.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    ids = ids.groupBy(F.col(id_col).alias("i")).agg(F.min(label).cast("int").alias("y"))
    # Bounded by ``rows``.
    ids = F.broadcast(ids.orderBy(F.xxhash64("i"), "i").limit(rows))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(ids, F.col("id") == F.col("i"))

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        return {"id": batch.column(0), "y": batch.column(1), "x": [features(t) for t in texts_of(batch.column(2))]}

    kind = docs.schema[id_col].dataType.simpleString()
    found = arrow_map(own.select("id", "y", "t"), of, f"id {kind}, y int, x array<double>")
    return found.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x"))


def train(docs: DataFrame, labels: DataFrame, **options) -> Trees | None:
    """Trees fitted on the sample, in the order of the ids; None without labels."""
    fitting = {k: options.pop(k) for k in ("trees", "depth", "bins", "rate") if k in options}
    rows = sample(docs, labels, **options).toArrow().sort_by("id")
    if not rows.num_rows:
        return None
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy().astype(np.float64)
    return fit(x, y, **fitting)


def score(docs: DataFrame, trees: Trees | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``: all columns stay, one of that name is replaced.

    A null text scores as an empty one. Without a model every score is 0.5.
    """
    docs = docs.drop("quality_score")
    names = docs.columns
    at = names.index(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        x = np.array([features(t) for t in texts_of(batch.column(0).field(at))])
        scores = np.full(len(x), 0.5) if sent.value is None else sent.value.scores(x)
        return {"row": batch.column(0), "quality_score": scores}

    rows = docs.select(row)
    schema = T.StructType([*rows.schema.fields, T.StructField("quality_score", T.DoubleType())])
    return arrow_map(rows, of, schema).select("row.*", "quality_score")


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = 0.7, text_col: str = "text", **options) -> DataFrame:
    """The rows that score ``least`` or more, same columns; all without labels."""
    trees = train(docs, labels, text_col=text_col, **options)
    if trees is None:
        return docs
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    packed = docs.select(row, F.col(text_col).alias("t"))
    return score(packed, trees, text_col="t").where(F.col("quality_score") >= least).select("row.*")
