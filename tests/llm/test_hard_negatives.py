"""Mining against plain sums over all rows, with odd vectors; bounds that never lose a row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casesignal.llm.hard_negatives import Chunk, labelled_vectors, mine, resolve

SCHEMA = "vec_id long, embedding array<float>, label int, v string, row int, score int"


def plain(rows, step, k=5):
    own = []
    for vec_id, e, label, *_ in rows:
        if vec_id is None or e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own.append((vec_id, label, [math.floor(float(x) * 256) for x in e]))
    out = []
    for a, (anchor, label, v) in enumerate(own):
        if anchor % step:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, b, other) for b, (i, other, w) in enumerate(own) if b != a]
        scores.sort()
        for ps, positive, *_ in [s for s in scores if s[3] == label][:k]:
            fits = [s for s in scores if s[3] != label and -80 * ps <= -100 * s[0] <= -100 * ps]
            out += [(anchor, positive, r + 1, s[1], -ps, -s[0]) for r, s in enumerate(fits[:k])]
    return sorted(out)


def run(spark, rows, step, **options):
    table = spark.createDataFrame([(*r, "v", 1, 2) for r in rows], SCHEMA).repartition(options.pop("partitions", 3))
    vectors = labelled_vectors(table)
    return sorted(map(tuple, mine(vectors, vectors.where(F.col("vec_id") % step == 0), **options).collect()))


def odd_rows(width):
    return [(None, [1.0] * width, 1), (10, None, 1), (20, [None] * width, 1), (30, [float("nan")] * width, 1), (40, [float("-inf")] + [0.0] * (width - 1), 1), (50, [1.0] * width, None)]


@pytest.mark.parametrize(("n", "width", "chunk_rows", "block_rows"), [(300, 12, 17, 7), (300, 40, 1000, 4096), (200, 1, 5, 3), (6, 5, 2, 1)])
def test_equals_plain_sums(spark, n, width, chunk_rows, block_rows):
    rng = random.Random(n + width)
    # Quarters are exact in float; few values give many ties.
    rows = [(i, [rng.randint(-3, 5) / 4 for _ in range(width)], rng.randint(0, 3)) for i in range(n)]
    rows += rows[:12] + odd_rows(width) + [(0, [0.0] * width, 2), (500, [0.25] * width, 2)]
    want = plain(rows, 10)
    assert want
    assert run(spark, rows, 10, chunk_rows=chunk_rows, block_rows=block_rows) == want


def test_hot_vector_and_label(spark):
    """A third of all rows are one vector of one label: lists stay short and ties go by id."""
    rng = random.Random(5)
    rows = [(i, [0.5, 0.5, 1.0], 1) for i in range(400)] + [(1000 + i, [rng.random(), rng.random(), 1.0], rng.randint(0, 2)) for i in range(600)]
    assert run(spark, rows, 50, chunk_rows=64) == plain([(i, [float(np.float32(x)) for x in e], y) for i, e, y in rows], 50)


@pytest.mark.parametrize("big", [1e6, 3e5])
def test_large_components(spark, big):
    """Sums beyond 2**53 are added as whole numbers."""
    rng = random.Random(6)
    rows = [(i, [rng.choice([big, -big, 1.0, 0.25, big / 2]) for _ in range(30)], i % 2) for i in range(60)]
    assert run(spark, rows, 10, chunk_rows=16) == plain([(i, [float(np.float32(x)) for x in e], y) for i, e, y in rows], 10)


def test_scores_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="(?i)overflow|too large|long"):
        run(spark, [(i, [1e12, 1e12], 0) for i in range(4)], 1)
    with pytest.raises(Exception, match="beyond a long"):
        run(spark, [(i, [1e30], 0) for i in range(4)], 1)


def test_short_vectors(spark):
    rows = [(0, [1.0, 2.0, 3.0], 1), (1, [2.0], 1), (2, [], 1), (3, [1.75], 0), (4, [1.5, 0.125], 0)]
    full = [(i, [*e, *[0.0] * (3 - len(e))], y) for i, e, y in rows]
    assert run(spark, rows, 1) == plain(full, 1)


def test_empty_tables_and_lonely_anchors(spark):
    assert run(spark, [], 10) == []
    assert run(spark, [(10, [1.0], 3)], 10) == []
    assert run(spark, [(10, [1.0], 3), (11, [1.0], 4)], 10) == []
    assert run(spark, [(1, [1.0], 3), (2, [1.0], 3)], 10) == []


def test_relabelled(spark):
    rows = [(i, [i / 8, 1.0], i % 4) for i in range(60)]
    table = spark.createDataFrame([(*r, "v", 1, 2) for r in rows], SCHEMA)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = labelled_vectors(table, moved)
    got = sorted(map(tuple, mine(vectors, vectors.where("vec_id % 20 = 0")).collect()))
    assert got == plain([(i, e, (y + 1) % 10 if i % 7 == 0 else y) for i, e, y in rows], 20)


@pytest.mark.parametrize("seed", range(6))
def test_bitmap_keeps_the_best_of_every_window(seed):
    """Whatever the bounds throw out, the k best of each window come back with exact scores."""
    rng = np.random.default_rng(seed)
    n, width, k = 500, 48, 4
    columns = rng.integers(-200, 200, (width, n)) // rng.integers(1, 30, (width, 1))
    chunk = Chunk(np.arange(n), np.arange(n), rng.integers(0, 3, n), columns, 500)
    anchor = (rng.integers(-400, 400, width) // rng.integers(1, 60, width)).astype(float)
    exact = anchor @ chunk.columns
    bitmap = rng.random(n) < 0.7
    spread = np.sort(exact)
    windows = [(spread[350], spread[420]), (spread[100], spread[480]), (-np.inf, np.inf), (9e9, 9e9), (5, 4)]
    at, scores = resolve(chunk, anchor, bitmap, windows, k)
    assert (scores == exact[at]).all() and bitmap[at].all()
    for lo, hi in windows:
        fits = sorted(exact[bitmap & (exact >= lo) & (exact <= hi)])[-k:]
        assert sorted(scores[(scores >= lo) & (scores <= hi)])[-k:] == fits
    # With a narrow window most rows leave before their last dimension.
    few, _ = resolve(chunk, anchor, bitmap, [(spread[-3], np.inf)], k)
    assert len(few) <= 3
