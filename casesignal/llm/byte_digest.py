"""Quartile bucket digests: short fingerprints whose difference tells how alike texts are.

Each triplet of consecutive UTF-8 bytes falls into one of ``BUCKETS`` buckets.
The digest holds, for every bucket, the quartile of its count among all buckets
(two bits), beside the length and the ratios of the quartiles. Two digests are
compared bucket by bucket; the difference is bounded at what digests of
unrelated texts show, so a likeness runs from 0 to 1.

``changes`` digests every text, and an edited form that takes its tail from the
next document: one shuffle of the texts by range of the ids, then each task
walks its rows in order. Only the first and last row of each task meet in a
join, so no order over all rows is ever held in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.llm.common import arrow_map, arrow_schema, texts_of, to_batch
from casesignal.session import stored

BUCKETS = 512
#: A triplet, as a number of 24 bits, times this; the top bits are its bucket.
MULTIPLIER = 2654435761
#: Digests that differ by this or more are not alike at all. Two independent
#: digests differ by 5/4 a bucket on average.
BOUND = BUCKETS * 5 // 4
#: What one step of the length code, and of a quartile ratio, adds.
LENGTH_WEIGHT, RATIO_WEIGHT = 8, 4
#: Bytes taken at a time.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Digest:
    """Length code, ratios of the first two quartiles to the third, bucket codes."""

    length: int
    ratios: tuple[int, int]
    codes: np.ndarray

    def text(self) -> str:
        """Two hex digits of the length, one of each ratio, one for two buckets."""
        head = f"{self.length:02x}{self.ratios[0]:x}{self.ratios[1]:x}"
        pairs = self.codes.reshape(-1, 4) << np.array([6, 4, 2, 0], dtype=np.uint8)
        return head + pairs.sum(axis=1, dtype=np.uint8).tobytes().hex()


def parse(text: str) -> Digest:
    """The digest that ``Digest.text`` wrote."""
    packed = np.frombuffer(bytes.fromhex(text[4:]), dtype=np.uint8)
    codes = (packed[:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3
    return Digest(int(text[:2], 16), (int(text[2], 16), int(text[3], 16)), codes.ravel())


def length_code(size: int) -> int:
    """Quarters of an octave, by integers alone; 0 bytes give 0."""
    if size < 4:
        return size
    bits = size.bit_length()
    return 4 * (bits - 2) + ((size >> (bits - 3)) & 3)


def bucket_counts(text: bytes) -> np.ndarray:
    """Triplets in each bucket."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    shift = np.uint32(32 - (BUCKETS - 1).bit_length())
    for at in range(0, max(0, len(text) - 2), CHUNK):
        a = np.frombuffer(text[at : at + CHUNK + 2], dtype=np.uint8).astype(np.uint32)
        key = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        counts += np.bincount((key * np.uint32(MULTIPLIER)) >> shift, minlength=BUCKETS)
    return counts


def digest(text: bytes) -> Digest:
    """The digest of a text's UTF-8; under three bytes no bucket holds anything."""
    counts = bucket_counts(text)
    at = [BUCKETS * k // 4 - 1 for k in (1, 2, 3)]
    q1, q2, q3 = (int(v) for v in np.partition(counts, at)[at])
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    return Digest(length_code(len(text)), (15 * q1 // max(q3, 1), 15 * q2 // max(q3, 1)), codes.astype(np.uint8))


def differences(left: list[Digest], right: list[Digest]) -> np.ndarray:
    """Bounded difference score of each pair, from 0 to BOUND."""
    if not left:
        return np.zeros(0, dtype=np.int64)
    out = np.abs(np.stack([d.codes for d in left]).astype(np.int8) - np.stack([d.codes for d in right]).astype(np.int8)).sum(axis=1, dtype=np.int64)
    out += LENGTH_WEIGHT * np.abs(np.array([d.length for d in left]) - np.array([d.length for d in right]))
    out += RATIO_WEIGHT * np.abs(np.array([d.ratios for d in left]) - np.array([d.ratios for d in right])).sum(axis=1)
    return np.minimum(out, BOUND)


def likeness(left: list[Digest], right: list[Digest]) -> np.ndarray:
    """1 for equal digests, 0 for those BOUND or more apart."""
    return 1.0 - differences(left, right) / BOUND


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` of every row, without a shuffle; null text is empty."""

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        return {"id": batch.column(0), "fingerprint": [digest(t).text() for t in texts_of(batch.column(1))]}

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(F.col(id_col), F.col(text_col)), of, f"id {kind}, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def compare(pairs: DataFrame, left: str, right: str, out: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two fingerprint columns; null if either is null.

    All columns stay; one named ``out`` is replaced.
    """
    pairs = pairs.drop(out)
    row = F.struct(*[F.col(f"`{c}`") for c in pairs.columns]).alias("row")

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        both = [(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        known = [i for i, (a, b) in enumerate(both) if a is not None and b is not None]
        found: list[float | None] = [None] * len(both)
        alike = likeness([parse(both[i][0]) for i in known], [parse(both[i][1]) for i in known])
        for i, v in zip(known, alike.tolist(), strict=True):
            found[i] = v
        return {"row": batch.column(0), "__out": found}

    rows = pairs.select(row, F.col(f"`{left}`").alias("l"), F.col(f"`{right}`").alias("r"))
    schema = T.StructType([rows.schema["row"], T.StructField("__out", T.DoubleType())])
    return arrow_map(rows, of, schema).select("row.*", F.col("__out").alias(out))


def map_with_next(
    rows: DataFrame,
    order: list[str],
    prepare: Callable[[pa.RecordBatch], list],
    pair: Callable[[list, list], dict[str, object]],
    schema: str,
) -> DataFrame:
    """Map every row and the row after it in ``order``; after the last comes the first.

    ``prepare`` turns a batch into one item a row; ``pair`` turns items and
    their followers into the columns of ``schema``. Rows are shuffled once, by
    range; a task holds one batch. Rows equal in ``order`` follow one another.
    """
    result = T.StructType.fromDDL(schema)
    fields = T.StructType(
        [T.StructField("result", result), T.StructField("own", rows.schema), T.StructField("part", T.IntegerType()), T.StructField("is_last", T.BooleanType())]
    )
    target, inner = arrow_schema(fields), arrow_schema(result)

    def done(items: list, following: list) -> pa.RecordBatch:
        found = pa.StructArray.from_arrays(to_batch(pair(items, following), inner).columns, fields=list(inner))
        n = len(items)
        return to_batch({"result": found, "own": pa.nulls(n, target.field("own").type), "part": pa.nulls(n, pa.int32()), "is_last": pa.nulls(n, pa.bool_())}, target)

    def edge(row: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        own = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(row.columns, target.field("own").type, strict=True)], fields=list(target.field("own").type))
        part = TaskContext.get().partitionId()
        return to_batch({"result": pa.nulls(1, target.field("result").type), "own": own, "part": [part], "is_last": [last]}, target)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                yield edge(batch.slice(0, 1), False)
            items = held + prepare(batch)
            if len(items) > 1:
                yield done(items[:-1], items[1:])
            held, last = items[-1:], batch.slice(batch.num_rows - 1, 1)
        if last is not None:
            yield edge(last, True)

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    walked = stored(sorted_rows.mapInArrow(walk, fields), "walked")
    inside = walked.where("part IS NULL").select("result.*")
    # One first and one last row for each task.
    edges = walked.where("part IS NOT NULL")
    parts = edges.where("NOT is_last").select(F.col("part").alias("p"))
    after = F.lead("p").over(Window.orderBy("p"))
    parts = parts.select("p", F.coalesce(after, F.min("p").over(Window.partitionBy())).alias("following"))
    heads = edges.where("NOT is_last").select(F.col("part").alias("h"), F.col("own").alias("b"))
    tails = edges.where("is_last").select("part", F.col("own").alias("a"))
    met = tails.join(parts, F.col("part") == F.col("p")).join(heads, F.col("following") == F.col("h")).select("a", "b")

    def across(batch: pa.RecordBatch) -> dict[str, object]:
        a, b = (prepare(pa.RecordBatch.from_struct_array(batch.column(i))) for i in (0, 1))
        return pair(a, b)

    return inside.unionByName(arrow_map(met, across, schema))


def changes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside its edited form: digests, and how alike they are.

    In the edited text the last floor(n / 2) code points give way to as many
    (or all) from the start of the next document, by ascending id; after the
    last comes the first. Returns ``id_col``, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited (likeness to the edited text)
    and near_next (to the next document).

    A null text is empty. Rows that share an id follow by a hash of their text,
    rows without an id come last, in the same way. An only row follows itself.
    No rows give none; other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.col("id").isNull().alias("no_id"), F.xxhash64("text").alias("tie"))

    def prepare(batch: pa.RecordBatch) -> list:
        ids = batch.column(0).to_pylist()
        return [(i, t.decode("utf-8", "replace"), digest(t)) for i, t in zip(ids, texts_of(batch.column(1)), strict=True)]

    def pair(items: list, following: list) -> dict[str, object]:
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for (_, t, _), (_, u, _) in zip(items, following, strict=True)]
        raw = [e.encode() for e in edited]
        own, new, other = [x[2] for x in items], [digest(b) for b in raw], [x[2] for x in following]
        return {
            "id": [x[0] for x in items],
            "n_chars": [len(x[1]) for x in items],
            "edited_sha256": [hashlib.sha256(b).hexdigest() for b in raw],
            "fingerprint": [d.text() for d in own],
            "edited_fingerprint": [d.text() for d in new],
            "near_edited": likeness(own, new),
            "near_next": likeness(own, other),
        }

    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_with_next(rows, ["no_id", "id", "tie"], prepare, pair, schema).withColumnRenamed("id", id_col)
