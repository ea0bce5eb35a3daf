"""SimHash near-dedup: fingerprints, grid join on segment bit counts, groups.

A fingerprint's 64 bits are cut into 32 segments of two. The number of bits
set in each is the fingerprint's place on a grid; it is kept in unary (00, 01,
11), so the Manhattan distance of two places is a bit count of their XOR. It
never exceeds the bit distance, so pairs too far apart on the grid are dropped
before the exact check.

Range join on the grid: with the segments in ``distance + 2`` bands, two places
within the distance agree on two bands at least. A cell is a pair of bands with
their counts; fingerprints meet in each cell they share, once exact copies are
one fingerprint. A cell is searched breadth first, from the fingerprints not
yet reached, so it gives at most as many links as it has fingerprints. A cell
over ``cell_rows`` is dealt to blocks of that size, and each pair of blocks is
searched in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.llm.common import arrow_map, texts_of, words_of
from casesignal.llm.components import components
from casesignal.session import stored

SEED = 42
_LOW = 0x5555555555555555
#: Shingles turned into bits at a time.
CHUNK = 1 << 16


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each run of ``n`` words joined by spaces; fewer words: of all."""
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    text = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes)
    lo, hi = (ends - sizes)[: 1 - n or None].tolist(), (ends[n - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(lo, hi, strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; none: 0."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (long) of every row; null text has no words."""

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        prints = [fingerprint(shingle_hashes(words_of(t), words)) for t in texts_of(batch.column(1))]
        return {"id": batch.column(0), "fp": np.array(prints, dtype=np.uint64).view(np.int64)}

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(F.col(id_col), F.col(text_col)), of, f"id {kind}, fp bigint")
    return out.withColumnRenamed("id", id_col)


def grid_place(fp: Column) -> Column:
    """Bits set in each two-bit segment, in unary."""
    down = F.shiftrightunsigned(fp, 1)
    low, high = fp.bitwiseOR(down), fp.bitwiseAND(down)
    mask = F.lit(_LOW)
    return low.bitwiseAND(mask).bitwiseOR(F.shiftleft(high.bitwiseAND(mask), 1))


def _places(fps: np.ndarray) -> np.ndarray:
    down = fps >> np.uint64(1)
    return ((fps | down) & np.uint64(_LOW)) | ((fps & down & np.uint64(_LOW)) << np.uint64(1))


def band_masks(distance: int) -> list[int]:
    """A mask for each pair of ``distance + 2`` bands of whole segments."""
    bands = distance + 2
    edges = [round(32 * i / bands) for i in range(bands + 1)]
    own = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [x | y for x, y in combinations(own, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(fps: DataFrame, *, distance: int = 4, cell_rows: int = 4096) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints that span their groups.

    ``fps`` has distinct ``fp``. Two fingerprints within ``distance`` bits are
    linked by a chain of such links; not every pair is listed.
    """
    place = grid_place(F.col("fp"))
    cell = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("bands"), place.bitwiseAND(F.lit(m)).alias("at")) for i, m in enumerate(band_masks(distance))]))
    cells = fps.select("fp", cell.alias("c")).select("fp", "c.bands", "c.at")
    # Cells with company; the larger ones fall into several blocks.
    sizes = cells.groupBy("bands", "at").agg(F.count("*").alias("n")).where("n > 1")
    rows = cells.join(sizes, ["bands", "at"])
    blocks = F.ceil(F.col("n") / cell_rows).cast("int")
    own = F.pmod(F.xxhash64("fp", "bands"), blocks).cast("int")
    rows = rows.select("bands", "at", "fp", own.alias("block"), blocks.alias("blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bands", "at", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "fp")
    rows = rows.repartition("bands", "at", "x", "y").sortWithinPartitions("bands", "at", "x", "y", "fp")
    return rows.mapInArrow(_search(distance), "a bigint, b bigint")


def _search(distance: int):
    """Search each run of equal cells of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            here = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            here = here if rest is None else np.concatenate([rest, here], axis=1)
            edges = np.flatnonzero((here[:4, 1:] != here[:4, :-1]).any(axis=0)) + 1
            last = int(edges[-1]) if len(edges) else 0
            yield from _links(here[:, :last], distance)
            rest = here[:, last:]
        if rest is not None:
            yield from _links(rest, distance)

    return run


def _links(rows: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    if not rows.shape[1]:
        return
    edges = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
    starts = np.concatenate([[0], edges])
    sizes = np.diff(np.append(starts, rows.shape[1]))
    fps = rows[4].view(np.uint64)
    places = _places(fps)
    a, b = [], []
    # Small cells of one size are searched together, pair by pair.
    for size in np.unique(sizes):
        at = starts[sizes == size]
        if 2 <= size <= 16:
            grid = at[:, None] + np.arange(size)
            for i, j in combinations(range(int(size)), 2):
                x, y = grid[:, i], grid[:, j]
                near = np.bitwise_count(places[x] ^ places[y]) <= distance
                x, y = x[near], y[near]
                near = np.bitwise_count(fps[x] ^ fps[y]) <= distance
                a.append(x[near])
                b.append(y[near])
        elif size > 16:
            for lo in at.tolist():
                _breadth_first(fps, places, lo, lo + int(size), distance, a, b)
    if a and sum(map(len, a)):
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"])


def _breadth_first(fps, places, lo, hi, distance, a, b) -> None:
    """Links from each fingerprint to those near it that no other has reached."""
    left = np.arange(lo, hi)
    queue: list[int] = []
    while len(left):
        if queue:
            at = queue.pop()
        else:
            at, left = int(left[0]), left[1:]
        near = np.bitwise_count(places[left] ^ places[at]) <= distance
        near[near] = np.bitwise_count(fps[left[near]] ^ fps[at]) <= distance
        if near.any():
            found = left[near]
            a.append(np.full(len(found), at))
            b.append(found)
            queue += found.tolist()
            left = left[~near]


def _grouped(docs: DataFrame, words: int, distance: int, id_col: str, text_col: str, cell_rows: int) -> DataFrame:
    """``id_col``, fp, root and component_id of every row."""
    prints = stored(fingerprints(docs.select(F.col(id_col), F.col(text_col)), words=words, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    groups = components(near_links(distinct.select("fp"), distance=distance, cell_rows=cell_rows))
    rooted = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select(F.col("fp").alias("print"), "root", "component_id")
    return prints.join(named, prints["fp"] == named["print"]).select(id_col, "fp", "root", "component_id")


def near_dedup(docs: DataFrame, *, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 4096) -> DataFrame:
    """``id_col``, fingerprint, component_id of every row of ``docs``.

    Fingerprints within ``distance`` bits are linked; component_id is the
    smallest id of the group. A null, empty or blank text has no words and the
    fingerprint zero, which links like any other. A row without an id gets the
    smallest id of its group, null if no row of it has one. Repeated rows give
    repeated rows. Words are told apart by their UTF-8, A-Z in lower case.
    """
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _grouped(docs, words, distance, id_col, text_col, cell_rows).select(id_col, text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 4096) -> DataFrame:
    """One row of every group, all columns kept: the one with the smallest id.

    Of rows that share that id, and in groups without any id, the smallest
    fingerprint stays, and of equal ones the smallest row (columns that cannot
    be compared, such as maps, are an error only where ids repeat or lack).
    """
    found = stored(_grouped(docs, words, distance, id_col, text_col, cell_rows), "groups")
    first = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), F.col("fp"))).alias("w"))
    first = first.select(F.col("w.id").alias("keep_id"), F.col("w.fp").alias("keep_fp"))
    # Ids that several rows share, or that lack: there a row is more than its id.
    odd = found.groupBy(F.col(id_col).alias("odd_id")).agg(F.count("*").alias("n")).where("n > 1 OR odd_id IS NULL").select("odd_id")
    odd = stored(odd, "odd-ids")
    alone = first.where("keep_id IS NOT NULL").join(odd, F.col("keep_id") == F.col("odd_id"), "left_anti")
    kept = docs.join(alone, docs[id_col] == alone["keep_id"], "left_semi")
    names = docs.columns
    at = names.index(text_col)

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        prints = [fingerprint(shingle_hashes(words_of(t), words)) for t in texts_of(batch.column(0).field(at))]
        return {"row": batch.column(0), "print": np.array(prints, dtype=np.uint64).view(np.int64)}

    rows = docs.join(odd, docs[id_col].eqNullSafe(odd["odd_id"]), "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = arrow_map(rows, of, T.StructType([*rows.schema.fields, T.StructField("print", T.LongType())]))
    same = rows["row"][id_col].eqNullSafe(first["keep_id"]) & (rows["print"] == first["keep_fp"])
    # Rows of one text meet before the shuffle: only the smallest goes on.
    best = rows.join(first, same, "left_semi").groupBy("print", F.col("row")[id_col].alias("__id")).agg(F.min("row").alias("row"))
    return kept.unionByName(best.select("row.*"))
