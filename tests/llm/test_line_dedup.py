"""Line dedup against sets, insertions taken back, filters against sets."""

import random
from collections import defaultdict

import pytest

from casesignal.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines, digest, line_key


def plain(rows, limit):
    seen = defaultdict(set)
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if doc is not None:
                seen[line_key(x.encode())].add(doc)
    hot = {k for k, docs in seen.items() if k and len(docs) >= limit}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if line_key(x.encode()) not in hot]
        out.append((doc, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.doc_id, r.line_dedup.text, r.line_dedup.n_lines, r.line_dedup.n_dropped) for r in df.collect()], key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    common = [" Shared Line\t", "shared line", "É menu", "é menu", "\x0bfoot\x0c", "ok", "x" * 5000]
    rows = [(i, "\n".join(rng.choice([*common, "", f"own {i}", f"pair {i // 2}"]) for _ in range(rng.randint(0, 7)))) for i in range(n)]
    return rows + [rows[3], rows[3], (None, "shared line\nonly here"), (n + 1, None), (None, None), (n + 2, "\r\n\r")]


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_equals_sets(spark, bound):
    """The second bound keeps the filters from being broadcast."""
    rows = corpus(200)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line_dedup int")
    assert rows_of(dedup_lines(df, min_docs=3, max_filter_bytes=bound, shards=5)) == plain(rows, 3)
    assert dedup_lines(df.limit(0), min_docs=3, max_filter_bytes=bound).collect() == []


def test_deletions_take_insertions_back(spark, tmp_path):
    first, second, third = corpus(60, 1), [(i + 1000, t) for i, t in corpus(60, 2)[:60]], [(i + 2000, t) for i, t in corpus(40, 3)[:40]]
    frames = [spark.createDataFrame(r, "doc_id long, text string") for r in (first, second, third)]
    index = LineIndex(spark, f"file://{tmp_path}/lines", min_docs=12, shards=3)
    index.insert(frames[0])
    before = {(bytes(r.key), r.n) for r in index.counts().collect()}
    kept = rows_of(index.dedup(frames[0]))
    assert kept == plain(first, 12)
    index.insert(frames[1])
    index.insert(frames[2])
    assert rows_of(index.dedup(frames[0].union(frames[1]).union(frames[2]))) == plain(first + second + third, 12)
    index.delete(frames[1])
    assert rows_of(index.dedup(frames[0].union(frames[2]))) == plain(first + third, 12)
    index.delete(frames[2])
    assert {(bytes(r.key), r.n) for r in index.counts().collect()} == before
    assert rows_of(index.dedup(frames[0])) == kept


def test_filter_inserts_deletes_and_fills():
    rng = random.Random(4)
    keys = [digest(rng.randbytes(8)) for _ in range(3000)]
    made = CuckooFilter.of(keys[:2000])
    assert made.contains(keys[:2000]).all() and made.contains(keys[2000:]).sum() == 0
    made.delete(keys[:1000])
    assert made.contains(keys[1000:2000]).all() and made.contains(keys[:1000]).sum() == 0
    small = CuckooFilter.sized(8)
    assert not small.insert(keys)


def test_keys_shorter_than_the_limit_stay(spark):
    rows = [(i, "éé\nééé") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_lines(df, min_docs=2, min_chars=3).collect()
    assert {r.line_dedup.text for r in got} == {"éé"}
