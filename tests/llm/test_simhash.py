"""Fingerprints and groups against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casesignal.llm.components import components
from casesignal.llm.registry import op1_simhash
from casesignal.llm.simhash import band_masks, grid_place, keep_one, near_dedup, near_links


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_groups(fps, distance=4):
    """Smallest index reachable from each."""
    fps = np.array(fps, dtype=np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    roots = plain_groups(fps)
    want = {d: (f"{f:016x}", docs[r][0]) for (d, _), f, r in zip(docs, fps, roots, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("cell_rows", [5, 4096])
def test_links_span_all_near_pairs(spark, cell_rows):
    """Random fingerprints, chains and a dense group; small cells are split."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = [int(b) for b in base]
    for b in base[:60]:
        for _ in range(3):
            x = int(b)
            for i in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(i)
            near.append(x)
    center = int(base[0])
    near += [center ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 64, (300, 2))]
    fps = sorted(set(near))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    links = near_links(df, cell_rows=cell_rows)
    own = {int(np.uint64(x).astype(np.int64)): x for x in fps}
    pairs = links.collect()
    assert all(bin(own[r.a] ^ own[r.b]).count("1") <= 4 for r in pairs)
    found = {r.node: r.root for r in components(links).collect()}
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    groups = plain_groups(fps)
    by_root = {}
    for x, g in zip(signed, groups, strict=True):
        by_root.setdefault(g, []).append(x)
    want = {x: min(v) for v in by_root.values() if len(v) > 1 for x in v if x != min(v)}
    assert found == want


def test_grid_distance_is_a_lower_bound(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(2**63), 2**63 - 1, (200, 2))]
    df = spark.createDataFrame(pairs, "x long, y long")
    got = df.select("x", "y", F.bit_count(grid_place(F.col("x")).bitwiseXOR(grid_place(F.col("y")))).alias("d")).collect()
    for r in got:
        x, y = r.x % 2**64, r.y % 2**64
        counts = [abs(bin(x >> s & 3).count("1") - bin(y >> s & 3).count("1")) for s in range(0, 64, 2)]
        assert r.d == sum(counts) <= bin(x ^ y).count("1")
    assert len(band_masks(4)) == 15


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(3, "one two three four five", "f"), (None, None, "f"), (7, "", "f"), (9, " \n", "f"), (3, "one two three four five", "f"),
            (5, "ONE two\nthree four five", "f"), (None, "one two three four five", "g"), (None, "alone here in the world", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted([(r.doc_id, r.component_id) for r in near_dedup(df).collect()], key=str)
    assert got == sorted([(3, 3), (None, 7), (7, 7), (9, 7), (3, 3), (5, 3), (None, 3), (None, None)], key=str)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "alone here in the world"), (3, rows[0][1]), (7, "")]
    assert near_dedup(df.limit(0)).collect() == []


def test_keep_one_leaves_one_row_of_each_group(spark):
    """Copies without an id, rows that repeat an id, and one id on texts of several groups."""
    a, b, c = "copies of a text that has no id", "another text of its own group here", "a third one, quite unlike the rest of them"
    rows = [(None, a, i) for i in range(50)] + [(4, b, i) for i in range(3)] + [(4, c, 9), (6, c, 1), (2, b.upper(), 5), (8, "single row", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, odd_id int").repartition(7)
    got = sorted(map(tuple, keep_one(df).collect()), key=str)
    assert got == sorted([(None, a, 0), (2, b.upper(), 5), (4, c, 9), (8, "single row", 0)], key=str)
    assert keep_one(df.limit(0)).collect() == []
    same = df.where("doc_id = 4 AND odd_id < 9")
    assert [tuple(r) for r in keep_one(same).collect()] == [(4, b, 0)]
