"""Hard-negative mining by a vertical scan with shrinking candidate bitmaps.

Rows are held column by column in chunks. An anchor reads the dimensions in
descending order of its own magnitudes, a few at a time, and keeps partial
scores. The dimensions not yet read can add no more than their largest, and no
less than their smallest, contribution in the chunk: a candidate whose bounds
miss every wanted window leaves the bitmap, and scores are exact once all
dimensions are read.

Anchors go in blocks of bounded size against all rows, twice. First the best
rows of the anchor's own label are found: each task keeps a short list, which
gives it a floor for its later chunks, and the lists meet by anchor. Their
scores set the windows; then the best rows of other labels are found for each
window in the same way. What a task sends is at most ``k`` rows for each anchor
or window, however many rows share a label, a score or a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casesignal.session import scratch_path, stored

#: Rows of a chunk of columns.
CHUNK = 16_384
#: Dimensions read before the first, second ... look at the bitmap.
STEPS = (8, 16, 32)
#: Components of a block of anchors, at most, in bytes.
BLOCK_BYTES = 16 << 20
#: Sums of whole numbers below this are exact in doubles.
_EXACT = 1 << 53

_FOUND = "anchor bigint, slot int, row bigint, vec_id bigint, score bigint"


def labelled_vectors(
    table: DataFrame,
    label: Column | None = None,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
) -> DataFrame:
    """``row`` (unique), ``vec_id``, ``label`` and ``v``, each component as floor(scale * x).

    Rows without an id or a label, with a null vector, or with a null or
    non-finite component take no part. Rows that share an id stay rows of their
    own. ``label`` replaces the label column. A component beyond a long once
    scaled is an error.
    """
    x = F.col(vector_col).cast("array<double>")
    # x - x is 0 for finite numbers only.
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c - c))
    label = F.col(label_col) if label is None else label
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"), F.coalesce(odd, F.lit(True)).alias("odd"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND NOT odd")
    fits = F.forall("x", lambda c: F.abs(c * scale) < float(1 << 63))
    v = F.when(fits, F.transform("x", lambda c: F.floor(c * scale))).otherwise(F.raise_error(F.lit("component beyond a long")))
    kept = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", v.alias("v"))
    # The row numbers must not change between the passes.
    return stored(kept, "vectors")


@dataclass
class Anchors:
    """A block of anchors, and the windows of scores that each looks for.

    ``windows[a]`` holds (lo, hi) for the slots of anchor a; lists are kept
    for each slot. ``same`` tells whether candidates share the anchor's label.
    """

    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same: bool
    windows: list[list[tuple[float, float]]]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row for each dimension, one column for each vector; short vectors end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((width, len(sizes)), dtype=np.int64)
    out[at, row] = flat
    return out


def _largest(values: np.ndarray) -> int:
    """Largest magnitude, as a Python number."""
    return max(-int(values.min()), int(values.max())) if values.size else 0


class Chunk:
    """Rows of one label after another, column by column, with each dimension's range.

    Components are doubles where every sum against ``anchors`` is exact in
    them, and Python numbers otherwise.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray, anchors: int):
        order = np.argsort(labels, kind="stable")
        kind = np.float64 if _largest(columns) * anchors * max(1, len(columns)) < _EXACT else object
        self.rows, self.ids, self.columns = rows[order], ids[order], columns[:, order].astype(kind)
        self.labels, starts = np.unique(labels[order], return_index=True)
        self.starts = np.append(starts, len(rows))
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)
        self.place = dict(zip(self.rows.tolist(), range(len(rows)), strict=True))

    def bitmap(self, label: int, same: bool) -> np.ndarray:
        """Rows of the label, or of all others."""
        found = np.full(len(self.rows), not same)
        i = int(np.searchsorted(self.labels, label))
        if i < len(self.labels) and self.labels[i] == label:
            found[self.starts[i] : self.starts[i + 1]] = same
        return found


def _inside(low: np.ndarray, high: np.ndarray, windows: list[tuple[float, float]]) -> np.ndarray:
    """True where the range from low to high meets a window."""
    found = np.zeros(len(low), dtype=bool)
    for lo, hi in windows:
        found |= ((high >= lo) & (low <= hi)).astype(bool)
    return found


def _raised(low: np.ndarray, high: np.ndarray, window: tuple[float, float], k: int) -> tuple[float, float]:
    """The window from the k-th largest lower bound of the candidates surely in it."""
    lo, hi = window
    sure = low[((low >= lo) & (high <= hi)).astype(bool)]
    if len(sure) < k:
        return window
    return max(lo, np.partition(sure, len(sure) - k)[len(sure) - k]), hi


def resolve(chunk: Chunk, anchor: np.ndarray, bitmap: np.ndarray, windows: list[tuple[float, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the chunk and exact scores: the k best of each window are among them.

    Every row given is in a window; of rows in a window, some below its k best
    may be missing.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")[: np.count_nonzero(anchor)]
    # Bounds on what the dimensions from the i-th on can add.
    a, b = anchor[order] * chunk.least[order], anchor[order] * chunk.most[order]
    low_rest = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], 0)
    high_rest = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], 0)
    at = np.flatnonzero(bitmap)
    partial = np.zeros(len(at), dtype=chunk.columns.dtype)
    done = 0
    for end in [*(s for s in STEPS if s < len(order)), len(order)]:
        dims = order[done:end]
        held = chunk.columns[dims] if len(at) == len(bitmap) else chunk.columns[dims[:, None], at[None, :]]
        if len(dims):
            partial = partial + anchor[dims] @ held
        low, high = partial + low_rest[end], partial + high_rest[end]
        stay = _inside(low, high, [_raised(low, high, w, k) for w in windows])
        at, partial, done = at[stay], partial[stay], end
        if not len(at):
            break
    return at, partial


class _Lists:
    """The k best (score, smaller id, smaller row) so far for each slot of each anchor."""

    def __init__(self, anchors: Anchors, k: int):
        self.k, self.windows = k, [list(w) for w in anchors.windows]
        self.held: dict[tuple[int, int], list[tuple]] = {}

    def add(self, a: int, chunk: Chunk, at: np.ndarray, scores: np.ndarray) -> None:
        for slot, (lo, hi) in enumerate(self.windows[a]):
            mine = ((scores >= lo) & (scores <= hi)).astype(bool)
            if not mine.any():
                continue
            place, value = at[mine], scores[mine]
            if len(place) > self.k:
                # Ties of the k-th stay until ids decide.
                floor = np.partition(value, len(value) - self.k)[len(value) - self.k]
                place, value = place[value >= floor], value[value >= floor]
                if len(place) > self.k:
                    by_id = np.lexsort((chunk.rows[place], chunk.ids[place]))
                    best = by_id[np.argsort(-value[by_id], kind="stable")][: self.k]
                    place, value = place[best], value[best]
            new = [(-int(s), int(i), int(r)) for s, i, r in zip(value, chunk.ids[place], chunk.rows[place], strict=True)]
            best = sorted(self.held.get((a, slot), []) + new)[: self.k]
            self.held[a, slot] = best
            if len(best) == self.k:
                self.windows[a][slot] = (max(lo, -best[-1][0]), hi)


def _scan(sent, k: int, width: int, chunk_rows: int):
    """Each task's short lists of the block's anchors."""

    def chunk(parts: list[pa.RecordBatch], anchors: int) -> Chunk:
        table = pa.Table.from_batches(parts).combine_chunks()
        rows, ids, labels = (table.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        return Chunk(rows, ids, labels, _matrix(table.column("v").chunk(0), width), anchors)

    def chunks(batches: Iterator[pa.RecordBatch], anchors: int) -> Iterator[Chunk]:
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(start, chunk_rows)
                if n + part.num_rows > chunk_rows:
                    yield chunk(held, anchors)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield chunk(held, anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = sent.value
        lists = _Lists(anchors, k)
        for c in chunks(batches, _largest(anchors.vectors)):
            vectors = anchors.vectors.astype(c.columns.dtype)
            for a, label in enumerate(anchors.labels.tolist()):
                if not lists.windows[a]:
                    continue
                bitmap = c.bitmap(label, anchors.same)
                own = c.place.get(int(anchors.rows[a]))
                if own is not None:
                    bitmap[own] = False
                lists.add(a, c, *resolve(c, vectors[a], bitmap, lists.windows[a], k))
        found = [(int(anchors.rows[a]), slot, r, i, -s) for (a, slot), best in lists.held.items() for s, i, r in best]
        if found:
            names = ["anchor", "slot", "row", "vec_id", "score"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``rank`` (from 1) of the k best of each slot; a task sent k at most."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    *,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    block_rows: int = 4096,
    chunk_rows: int = CHUNK,
) -> DataFrame:
    """Hard negatives of each anchor and positive, from ``labelled_vectors``.

    A positive is one of the ``positives`` best other rows of the anchor's
    label; its negatives are the ``negatives`` best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    Scores are integer inner products; ties go to the smaller id. Vectors
    shorter than the longest count as filled with zeros.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. Anchors are rows of ``vectors``; two that share an id give
    rows of their own. An anchor without positives, or a positive without
    negatives, gives no row. A score beyond a long is an error.
    """
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, width))))
    blocks = max(1, -(-anchors.count() // block_rows))
    rows = vectors.select("row", "vec_id", "label", "v")
    path = scratch_path(spark, "anchors")
    dealt = anchors.select(rows.columns).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    dealt.repartition("block").write.partitionBy("block").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    out = None
    for i in range(blocks):
        # About ``block_rows`` rows.
        held = dealt.where(F.col("block") == i).drop("block").toArrow().combine_chunks().sort_by("row")
        if not held.num_rows:
            continue
        ids, labels = held.column("row").to_numpy(), held.column("label").to_numpy()
        whole = np.ascontiguousarray(_matrix(held.column("v").combine_chunks(), width).T)
        block = Anchors(ids, labels, whole, True, [[(-np.inf, np.inf)]] * len(ids))
        best = stored(_merged(rows.mapInArrow(_scan(spark.sparkContext.broadcast(block), positives, width, chunk_rows), _FOUND), positives), "positives")
        windows: list[list[tuple[float, float]]] = [[] for _ in ids]
        # At most ``positives`` rows for each anchor of the block.
        for r in best.select("anchor", "rank", "score").orderBy("anchor", "rank").collect():
            s = r["score"]
            windows[int(np.searchsorted(ids, r["anchor"]))].append((-(-low * s // 100), high * s // 100))
        block = Anchors(ids, labels, whole, False, windows)
        found = _merged(rows.mapInArrow(_scan(spark.sparkContext.broadcast(block), negatives, width, chunk_rows), _FOUND), negatives)
        pos = best.select(F.col("anchor").alias("a"), (F.col("rank") - 1).alias("s"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        names = dealt.where(F.col("block") == i).select(F.col("row").alias("n"), F.col("vec_id").alias("anchor_id"))
        part = found.join(pos, (F.col("anchor") == F.col("a")) & (F.col("slot") == F.col("s"))).join(names, F.col("anchor") == F.col("n"))
        part = part.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part = stored(part, "negatives")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return out
