"""Exact search against plain sums, with odd vectors."""

import math
import random
import struct

import pytest

from casesignal.llm.topk import integer_vectors, top_k

SCHEMA = "vec_id long, embedding array<float>, score int, v string"


def plain(rows, k, step):
    """Every row on its own, also of those that share an id."""
    own = []
    for vec_id, e, *_ in rows:
        if vec_id is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own.append((vec_id, [math.floor(x * 256) for x in e]))
    out = []
    for a, (q, v) in enumerate(own):
        if q % step == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(own) if b != a)
            out += [(q, i + 1, x, -s) for i, (s, x) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "width", "slices", "block_rows"), [(300, 8, 2, 7), (300, 3, 3, 1000), (4, 5, 2, 1000), (60, 1, 2, 3)])
def test_equals_plain_sums(spark, n, width, slices, block_rows):
    rng = random.Random(n + width)
    # Quarters are exact in float; few values give many ties.
    rows = [(i, [rng.randint(-6, 6) / 4 for _ in range(width)], 1, "x") for i in range(n)]
    rows += rows[:3] + [(None, [1.0] * width, 1, "x"), (n + 5, None, 1, "x"), (n + 10, [None] * width, 1, "x"), (n + 20, [float("nan")] * width, 1, "x"), (n + 30, [float("inf")] + [0.0] * (width - 1), 1, "x")]
    rows += [(7, [-9.0] * width, 2, "y")] + [(1000 + i, [1.25] * width, 1, "hot") for i in range(n)]
    vectors = integer_vectors(spark.createDataFrame(rows, SCHEMA))
    got = top_k(vectors, vectors.where("vec_id % 10 = 0"), k=5, slices=slices, block_rows=block_rows)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5, 10)


def test_short_vectors_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0], 1, ""), (1, [1.0], 1, ""), (2, [], 1, "")]
    vectors = integer_vectors(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in top_k(vectors, vectors.where("vec_id = 0")).collect()} == {(0, 1, 1, 65536), (0, 2, 2, 0)}
    none = vectors.where("vec_id < 0")
    assert top_k(none, none).collect() == [] and top_k(vectors, none).collect() == []


@pytest.mark.parametrize("big", [70_000.0, 1e6, 3e5])
def test_large_components(spark, big):
    """Finite vectors of any size take part, as queries and as candidates, with exact scores."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([big, -big, 1.0, 0.25, big / 2, 0.0]) for _ in range(20)], 1, "x") for i in range(60)]
    rows += [(100, [big, 1.0], 1, "x"), (100, [1.0, big], 1, "x")]
    rows = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in e] + [0.0] * (20 - len(e)), y, v, 0) for i, e, y, v in rows]
    vectors = integer_vectors(spark.createDataFrame(rows, SCHEMA + ", row int"))
    got = top_k(vectors, vectors.where("vec_id % 10 = 0"), k=5, block_rows=3)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5, 10)


def test_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="beyond a long"):
        integer_vectors(spark.createDataFrame([(0, [1e30], 1, "")], SCHEMA)).collect()
