"""Reversible line dedup: exact reference counts with cuckoo filters in front.

The index is a folder of signed count tables (``key``, ``n``), one for each
insertion or deletion of documents; the reference count of a line is their sum,
so a deletion takes back exactly what the insertion gave. Lines found in at
least ``min_docs`` documents are hot. Each shard of the hot keys has a cuckoo
filter, which follows the counts: keys that cross the limit upwards are
inserted, keys that fall below it are deleted.

``dedup`` looks lines up in the filters. The index holds every key of its
documents, so the few cold keys that a filter takes for hot are found by
probing the whole table once and are excluded: the result is exact. Filters
over ``max_filter_bytes`` are not broadcast; then lines meet the hot keys in a
join.

Key of a line: 128 bits of BLAKE2b of the stripped, lower-cased line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.llm.common import SPACES, arrow_map, texts_of
from casesignal.session import scratch_path

SLOTS = 4
MAX_KICKS = 500
_EMPTY = np.uint32(0)


def line_key(line: bytes) -> bytes:
    """The line stripped of white space at both ends, A-Z in lower case."""
    return line.strip(SPACES).lower()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket hash and non-zero 32-bit fingerprint of each digest."""
    both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    print32 = (both[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return both[:, 0].copy(), np.where(print32 == 0, np.uint32(1), print32)


def _spread(prints: np.ndarray) -> np.ndarray:
    """The offset between the two buckets of a fingerprint."""
    return (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; supports insert, delete, contains."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        rows = 1 << max(2, int(np.ceil(np.log2(max(1, n) / SLOTS / 0.7))))
        return cls(np.zeros((rows, SLOTS), dtype=np.uint32))

    @classmethod
    def of(cls, digests: list[bytes]) -> CuckooFilter:
        room = len(digests)
        while True:
            made = cls.sized(room)
            if made.insert(digests):
                return made
            room = 2 * room + 4

    def _places(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.buckets) - 1)
        where, prints = _halves(digests)
        first = (where >> np.uint64(16)) & mask
        return first.astype(np.int64), ((first ^ _spread(prints)) & mask).astype(np.int64), prints

    def insert(self, digests: list[bytes]) -> bool:
        """False if a fingerprint found no room: rebuild from the exact table."""
        if not digests:
            return True
        mask = len(self.buckets) - 1
        for a, b, p in zip(*(x.tolist() for x in self._places(digests)), strict=True):
            if self._put(a, p) or self._put(b, p):
                continue
            at = b
            for kick in range(MAX_KICKS):
                slot = (p + kick) % SLOTS
                p, self.buckets[at, slot] = int(self.buckets[at, slot]), p
                at = (at ^ int(_spread(np.array([p], dtype=np.uint32))[0])) & mask
                if self._put(at, p):
                    break
            else:
                return False
        return True

    def _put(self, at: int, p: int) -> bool:
        free = np.flatnonzero(self.buckets[at] == _EMPTY)
        if len(free):
            self.buckets[at, free[0]] = p
        return bool(len(free))

    def delete(self, digests: list[bytes]) -> None:
        """Remove one copy of each; only keys that were inserted may be given."""
        if not digests:
            return
        for a, b, p in zip(*(x.tolist() for x in self._places(digests)), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.buckets[at] == p)
                if len(held):
                    self.buckets[at, held[0]] = _EMPTY
                    break

    def contains(self, digests: list[bytes]) -> np.ndarray:
        a, b, p = self._places(digests)
        mine = p[:, None]
        return (self.buckets[a] == mine).any(axis=1) | (self.buckets[b] == mine).any(axis=1)


@dataclass
class HotLines:
    """The filters of all shards and the cold keys they would take for hot."""

    shards: int
    filters: dict[int, CuckooFilter]
    excluded: set[bytes] = field(default_factory=set)

    def contains(self, digests: list[bytes]) -> np.ndarray:
        out = np.zeros(len(digests), dtype=bool)
        if not digests or not self.filters:
            return out
        shard = _shard_numbers(digests, self.shards)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
            at = order[lo:hi]
            found = self.filters.get(int(shard[at[0]]))
            if found is not None:
                out[at] = found.contains([digests[i] for i in at])
        if self.excluded:
            for i in np.flatnonzero(out):
                out[i] = digests[i] not in self.excluded
        return out


def _shard_numbers(digests: list[bytes], shards: int) -> np.ndarray:
    first = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 16)[:, :2].astype(np.int64)
    return (first[:, 0] * 256 + first[:, 1]) % shards


def _shard_column(key: Column, shards: int) -> Column:
    return (F.conv(F.hex(F.substring(key, 1, 2)), 16, 10).cast("int") % shards).cast("int")


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int = 1) -> DataFrame:
    """One row (``doc``, ``key``) for each distinct key of a text."""

    def keys(batch: pa.RecordBatch) -> dict[str, object]:
        ids, out, rows = batch.column(0).to_pylist(), [], []
        for doc, text in zip(ids, texts_of(batch.column(1)), strict=True):
            found = {line_key(x) for x in text.split(b"\n")}
            found = [digest(k) for k in found if _long_enough(k, min_chars)]
            out += found
            rows += [doc] * len(found)
        return {"doc": rows, "key": out}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), keys, f"doc {kind}, key binary")


class LineIndex:
    """Reference counts of lines in a folder all executors share.

    Documents are told apart by ``id_col``; rows without an id do not count
    towards the number of documents, but lose hot lines like any other. Insert
    a document once, and delete it with the text it was inserted with.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        *,
        min_docs: int = 10,
        min_chars: int = 1,
        shards: int = 64,
        max_filter_bytes: int = 64 << 20,
    ):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        self.min_docs, self.min_chars = min_docs, min_chars
        self.max_filter_bytes = max_filter_bytes
        self._changes = 0
        self._filters: DataFrame | None = None

    def counts(self) -> DataFrame:
        """The exact table: ``key`` and the number ``n`` of documents with it."""
        if not self._changes:
            return self.spark.createDataFrame([], "key binary, n bigint")
        parts = [f"{self.path}/counts-{i}" for i in range(self._changes)]
        table = self.spark.read.schema("key binary, n bigint").parquet(*parts)
        if self._changes > 1:
            table = table.groupBy("key").agg(F.sum("n").alias("n"))
        return table.where("n > 0")

    def hot(self) -> DataFrame:
        return self.counts().where(F.col("n") >= self.min_docs).select("key")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self._change(docs, id_col, text_col, 1)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self._change(docs, id_col, text_col, -1)

    def _change(self, docs: DataFrame, id_col: str, text_col: str, sign: int) -> None:
        rows = line_keys(docs, id_col, text_col, self.min_chars)
        delta = rows.groupBy("key").agg((F.count_distinct("doc") * sign).alias("n"))
        before = self.counts()
        to = f"{self.path}/counts-{self._changes}"
        delta.write.mode("overwrite").parquet(to)
        first = self._changes == 0
        self._changes += 1
        delta = self.spark.read.schema("key binary, n bigint").parquet(to)
        if first:
            crossed = delta.where(F.col("n") >= self.min_docs).select("key", F.lit(True).alias("up"))
        else:
            both = delta.join(before.withColumnRenamed("n", "was"), "key", "left")
            was = F.coalesce("was", F.lit(0))
            crossed = both.select("key", (was >= self.min_docs).alias("a"), (was + F.col("n") >= self.min_docs).alias("up"))
            crossed = crossed.where("a <> up").select("key", "up")
        self._update(crossed)

    def _update(self, crossed: DataFrame) -> None:
        """Bring the filters up to date with the keys that crossed the limit."""
        schema = "shard int, buckets binary"
        old = self._filters
        if old is None:
            old = self.spark.createDataFrame([], schema)

        def step(_, held: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            up = [bytes(k) for k in moved.loc[moved["up"].astype(bool), "key"]]
            down = [bytes(k) for k in moved.loc[~moved["up"].astype(bool), "key"]]
            shard = int(held["shard"].iloc[0] if len(held) else moved["shard"].iloc[0])
            if len(held):
                raw = held["buckets"].iloc[0]
                own = None if raw is None else CuckooFilter(np.frombuffer(raw, dtype=np.uint32).reshape(-1, SLOTS).copy())
                if own is not None:
                    own.delete(down)
                    own = own if own.insert(up) else None
            else:
                own = CuckooFilter.of(up)
            return pd.DataFrame({"shard": [shard], "buckets": [None if own is None else own.buckets.tobytes()]})

        moved = crossed.withColumn("shard", _shard_column(F.col("key"), self.shards))
        made = old.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(step, schema)
        to = f"{self.path}/filters-{self._changes}"
        made.write.mode("overwrite").parquet(to)
        self._filters = self.spark.read.schema(schema).parquet(to)
        full = [r[0] for r in self._filters.where("buckets IS NULL").select("shard").collect()]
        if full:
            self._rebuild(full)

    def _rebuild(self, full: list[int]) -> None:
        """Make the filters of some shards anew from the exact table."""

        def build(keys: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.of([bytes(k) for k in keys["key"]])
            return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "buckets": [made.buckets.tobytes()]})

        schema = "shard int, buckets binary"
        hot = self.hot().withColumn("shard", _shard_column(F.col("key"), self.shards))
        new = hot.where(F.col("shard").isin(full)).groupBy("shard").applyInPandas(build, schema)
        to = f"{self.path}/filters-{self._changes}-rebuilt"
        self._filters.where(~F.col("shard").isin(full)).unionByName(new).write.mode("overwrite").parquet(to)
        self._filters = self.spark.read.schema(schema).parquet(to)

    def lookup(self) -> HotLines | None:
        """The filters for a broadcast, or None if they are over the bound."""
        if self._filters is None:
            return HotLines(self.shards, {})
        size = self._filters.select(F.sum(F.length("buckets"))).first()[0] or 0
        if size > self.max_filter_bytes:
            return None
        held = {
            r["shard"]: CuckooFilter(np.frombuffer(bytes(r["buckets"]), dtype=np.uint32).reshape(-1, SLOTS))
            for r in self._filters.where("buckets IS NOT NULL").collect()
        }
        found = HotLines(self.shards, held)
        sent = self.spark.sparkContext.broadcast(found)

        def wrong(batch: pa.RecordBatch) -> dict[str, object]:
            keys = batch.column(0).to_pylist()
            return {"key": [k for k, hit in zip(keys, sent.value.contains(keys), strict=True) if hit]}

        cold = self.counts().where(F.col("n") < self.min_docs).select("key")
        # Expected: 8 in 2**32 of the cold keys.
        limit = self.max_filter_bytes // 64
        bad = arrow_map(cold, wrong, "key binary").limit(limit + 1).collect()
        if len(bad) > limit:
            return None
        found.excluded = {bytes(r[0]) for r in bad}
        return found

    def dedup(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ``line_dedup`` struct: kept text, n_lines, n_dropped.

        A null or empty text is one empty line. Expects documents that were
        inserted. All columns stay; a column of that name is replaced.
        """
        hot = self.lookup()
        docs = docs.drop("line_dedup")
        if hot is not None:
            sent = self.spark.sparkContext.broadcast(hot)
            return _apply(docs, text_col, self.min_chars, lambda keys, _: sent.value.contains(keys))
        return self._dedup_by_join(docs, text_col)

    def _dedup_by_join(self, docs: DataFrame, text_col: str) -> DataFrame:
        """For filters over the bound: the hot keys of each distinct text."""
        text = F.unhex(F.sha2(F.col(text_col), 256))
        keys = line_keys(docs.select(text.alias("text_id"), F.col(text_col)).where("text_id IS NOT NULL"), "text_id", text_col, self.min_chars)
        found = keys.distinct().join(self.hot(), "key", "left_semi")
        found = found.groupBy("doc").agg(F.collect_list("key").alias("hot_keys"))
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        left = docs.select(row, text.alias("text_id"))
        both = left.join(found, left["text_id"] == found["doc"], "left").select("row", "hot_keys")
        return _apply(both, text_col, self.min_chars, lambda keys, hot: np.array([k in hot for k in keys], dtype=bool), packed=True)


def _apply(docs: DataFrame, text_col: str, min_chars: int, is_hot, packed: bool = False) -> DataFrame:
    """Drop hot lines; ``is_hot(digests, hot keys of the row)`` marks them."""
    names = docs.select("row.*").columns if packed else docs.columns
    if not packed:
        docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.lit(None).cast("array<binary>").alias("hot_keys"))
    at = names.index(text_col)

    def drop(batch: pa.RecordBatch) -> dict[str, object]:
        texts = texts_of(batch.column(0).field(at))
        lists = batch.column(1).to_pylist() if packed else None
        lines = [t.split(b"\n") for t in texts]
        digests, places = [], []
        marks = [np.zeros(len(x), dtype=bool) for x in lines]
        for d, own in enumerate(lines):
            for i, line in enumerate(own):
                key = line_key(line)
                if _long_enough(key, min_chars):
                    digests.append(digest(key))
                    places.append((d, i))
        if packed:
            sets = [set(x or ()) for x in lists]
            hits = [k in sets[d] for k, (d, _) in zip(digests, places, strict=True)]
        else:
            hits = is_hot(digests, None)
        for hit, (d, i) in zip(hits, places, strict=True):
            marks[d][i] = hit
        kept = [
            (t if not m.any() else b"\n".join([x for x, gone in zip(own, m, strict=True) if not gone])).decode("utf-8", "replace")
            for t, own, m in zip(texts, lines, marks, strict=True)
        ]
        made = pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array([len(m) for m in marks], pa.int64()), pa.array([int(m.sum()) for m in marks], pa.int64())],
            names=["text", "n_lines", "n_dropped"],
        )
        return {"row": batch.column(0), "line_dedup": made}

    schema = docs.select("row").schema.add("line_dedup", T.StructType.fromDDL("text string, n_lines bigint, n_dropped bigint"))
    return arrow_map(docs, drop, schema).select("row.*", "line_dedup")


def dedup_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Index all of ``docs`` in the shared folder and dedup them against it."""
    spark = docs.sparkSession
    index = LineIndex(spark, scratch_path(spark, "lines"), min_docs=min_docs, min_chars=min_chars, **options)
    index.insert(docs, id_col, text_col)
    return index.dedup(docs, text_col)
