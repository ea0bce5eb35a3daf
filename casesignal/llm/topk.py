"""Exact top-k by inner product: three phases with a uniform threshold.

A vector is cut into slices, and a score is the sum of its slices' partial
scores. Phase one gathers, for each query, the best partial scores of each
slice and what those candidates score in all; the k-th best of these totals is
a safe cutoff. Phase two broadcasts it: a candidate that reaches the cutoff
must reach an equal share of it in one slice at least, so each slice sends the
entries over that share, and no others are needed. Phase three adds up what is
known, drops candidates whose upper bound is below the cutoff, and computes the
missing slices of the rest exactly.

Queries go in blocks of bounded size against all rows, so what is broadcast
does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casesignal.session import scratch_path, stored

#: Sums of whole numbers below this are exact in doubles.
_EXACT = 1 << 53
ROWS = 1024


def integer_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``row`` (unique), ``vec_id`` and ``v``, each component as floor(scale * x).

    Rows without an id, null vectors, and vectors that hold a null or a
    non-finite component take no part. Rows that share an id stay rows of their
    own. A component beyond a long once scaled is an error.
    """
    x = F.col(vector_col).cast("array<double>")
    # x - x is 0 for finite numbers only.
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c - c))
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    fits = F.forall("x", lambda c: F.abs(c * scale) < float(1 << 63))
    v = F.when(fits, F.transform("x", lambda c: F.floor(c * scale))).otherwise(F.raise_error(F.lit("component beyond a long")))
    # The row numbers must not change between the phases.
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", v.alias("v")), "vectors")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of components; shorter vectors are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - starts[row]
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


def _largest(values: np.ndarray) -> int:
    """Largest magnitude, as a Python number."""
    return max(-int(values.min()), int(values.max())) if values.size else 0


class Block:
    """A block of queries: rows, components, slices."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, slices: int):
        self.rows, self.vectors = rows, vectors
        width = vectors.shape[1]
        self.edges = [round(width * i / slices) for i in range(slices + 1)]
        self.largest = _largest(vectors)

    def partials(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Row numbers, ids and the partial scores (query x row) of each slice.

        Sums of whole numbers below 2**53 are exact in doubles; rows of larger
        components are added up as Python numbers.
        """
        numbers, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        width = self.vectors.shape[1]
        rows = _matrix(batch.column(2), width)
        for at in range(0, len(ids), ROWS):
            part = rows[at : at + ROWS]
            kind = np.float64 if _largest(part) * self.largest * max(1, width) < _EXACT else object
            part, own = part.astype(kind), self.vectors.astype(kind)
            yield numbers[at : at + ROWS], ids[at : at + ROWS], [own[:, a:b] @ part[:, a:b].T for a, b in zip(self.edges, self.edges[1:], strict=False)]


def _local_lists(block, k: int):
    """Phase one: the k best of each slice and query in one partition, with their totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        n, slices = len(own.rows), len(own.edges) - 1
        best = [np.full((n, 0), -np.inf) for _ in range(slices)]
        held = [np.zeros((n, 0), dtype=np.int64) for _ in range(slices)]
        names = [np.zeros((n, 0), dtype=np.int64) for _ in range(slices)]
        totals = [np.zeros((n, 0)) for _ in range(slices)]
        for batch in batches:
            for rows, ids, parts in own.partials(batch):
                total = sum(parts)
                for s, part in enumerate(parts):
                    part = np.where(rows[None, :] == own.rows[:, None], -np.inf, part)
                    every = np.concatenate([best[s], part], axis=1)
                    # Any k of the best will do: they only set the cutoff.
                    top = np.argsort(-every, axis=1, kind="stable")[:, :k] if every.dtype == object else np.argpartition(-every, min(k, every.shape[1]) - 1, axis=1)[:, :k]
                    wide = [np.concatenate([old, np.broadcast_to(new, part.shape)], axis=1) for old, new in ((held[s], rows), (names[s], ids), (totals[s], total))]
                    best[s], held[s], names[s], totals[s] = (np.take_along_axis(x, top, axis=1) for x in (every, *wide))
        for s in range(slices):
            query, at = np.nonzero((best[s] != -np.inf).astype(bool))
            if len(query):
                yield _entries(own.rows[query], s, held[s][query, at], names[s][query, at], totals[s][query, at])

    return run


def _sufficient(block, cutoffs):
    """Phase two: entries that reach an equal share of the cutoff, if the row's total reaches it.

    The task has all slices of a row at hand, so it sends no row that is out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        slices = len(own.edges) - 1
        for batch in batches:
            for rows, ids, parts in own.partials(batch):
                floor = cutoffs.value[:, None].astype(parts[0].dtype) if parts[0].dtype == object else cutoffs.value[:, None].astype(np.float64)
                stay = (rows[None, :] != own.rows[:, None]) & (sum(parts) >= floor).astype(bool)
                for s, part in enumerate(parts):
                    query, at = np.nonzero((part * slices >= floor).astype(bool) & stay)
                    if len(query):
                        yield _entries(own.rows[query], s, rows[at], ids[at], part[query, at])

    return run


_ENTRY = "query bigint, slice int, row bigint, vec_id bigint, value bigint"


def _entries(queries, s: int, rows, ids, values) -> pa.RecordBatch:
    n = len(queries)
    return pa.RecordBatch.from_arrays(
        [pa.array(queries, pa.int64()), pa.array(np.full(n, s), pa.int32()), pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array([int(v) for v in values], pa.int64())],
        names=["query", "slice", "row", "vec_id", "value"],
    )


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, in two steps so that ties spread out."""
    order = [F.col("score").desc(), F.col("vec_id").asc(), F.col("row").asc()]
    salted = scores.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)))
    local = F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return salted.withColumn("rank", local).where(F.col("rank") <= k).withColumn("rank", rank).where(F.col("rank") <= k).drop("salt")


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, slices: int = 2, block_rows: int = 1024) -> DataFrame:
    """``query_id``, rank (from 1), ``vec_id``, score: each query's k best.

    ``vectors`` come from ``integer_vectors`` and ``queries`` are rows of them.
    A row is never its own candidate; ties go to the smaller id; with fewer
    candidates than k all are given. Rows that share an id are queries, and
    candidates, each on its own. Vectors shorter than the longest count as
    filled with zeros. No query gives no rows. A score beyond a long is an error.
    """
    spark = vectors.sparkSession
    context = spark.sparkContext
    vectors = vectors.select("row", "vec_id", "v")
    n, width = queries.count(), vectors.agg(F.max(F.size("v"))).first()[0] or 0
    blocks, slices = max(1, -(-n // block_rows)), max(1, min(slices, width))
    path = scratch_path(spark, "queries")
    dealt = queries.select("row", "vec_id", "v").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    dealt.repartition("block").write.partitionBy("block").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    found = None
    for i in range(blocks):
        mine = dealt.where(F.col("block") == i).drop("block")
        # About ``block_rows`` rows.
        held = mine.toArrow().combine_chunks().sort_by("row")
        if not held.num_rows:
            continue
        rows = held.column("row").to_numpy()
        block = context.broadcast(Block(rows, _matrix(held.column("v").combine_chunks(), width), slices))
        lists = vectors.mapInArrow(_local_lists(block, k), _ENTRY)
        local = lists.select("query", "row", "vec_id", F.col("value").alias("score")).distinct()
        kth = _best(local, k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("cutoff")).where(F.col("n") == k)
        cutoff = np.full(len(rows), -np.inf, dtype=object)
        # At most one row for each query of the block.
        for r in kth.collect():
            cutoff[np.searchsorted(rows, r["query"])] = r["cutoff"]
        entries = vectors.mapInArrow(_sufficient(block, context.broadcast(cutoff)), _ENTRY)
        part = _resolve(entries, vectors, mine, spark.createDataFrame(kth_rows(rows, cutoff), "q bigint, cutoff bigint"), slices)
        names = mine.select(F.col("row").alias("n"), F.col("vec_id").alias("query_id"))
        part = _best(part, k).join(F.broadcast(names), F.col("query") == F.col("n")).select("query_id", "rank", "vec_id", "score")
        part = stored(part, "top-k")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return found


def kth_rows(rows: np.ndarray, cutoff: np.ndarray) -> list[tuple[int, int | None]]:
    return [(int(q), None if c == -np.inf else int(c)) for q, c in zip(rows, cutoff, strict=True)]


def _resolve(entries: DataFrame, vectors: DataFrame, queries: DataFrame, cutoffs: DataFrame, slices: int) -> DataFrame:
    """Phase three: totals of the candidates that can reach the cutoff."""
    known = entries.groupBy("query", "row", "vec_id").agg(F.sum("value").alias("known"), F.count("*").alias("have"))
    # A block's cutoffs: at most block_rows rows.
    known = known.join(F.broadcast(cutoffs), F.col("query") == F.col("q")).drop("q")
    full = known.where(F.col("have") == slices).select("query", "row", "vec_id", F.col("known").alias("score"), "cutoff")
    open_ = known.where(F.col("have") < slices).select("query", "row", "vec_id", "cutoff")
    rows = vectors.select(F.col("row").alias("r"), F.col("v").alias("x"))
    asked = F.broadcast(queries.select(F.col("row").alias("q"), F.col("v").alias("y")))
    open_ = open_.join(rows, F.col("row") == F.col("r")).join(asked, F.col("query") == F.col("q"))
    # Sums beyond a long on the way to a score within it.
    products = F.zip_with("x", "y", lambda a, b: F.coalesce(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), F.lit(0).cast("decimal(38,0)")))
    total = F.aggregate(products, F.lit(0).cast("decimal(38,0)"), lambda s, p: (s + p).cast("decimal(38,0)"))
    open_ = open_.select("query", "row", "vec_id", total.cast("long").alias("score"), "cutoff")
    every = full.unionByName(open_)
    return every.where(F.col("cutoff").isNull() | (F.col("score") >= F.col("cutoff"))).drop("cutoff")
