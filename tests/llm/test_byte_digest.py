"""Digests against a plain count, changes against a plain walk, planted copies."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from casesignal.llm import byte_digest as bd

SCHEMA = "doc_id long, text string, id int, own string, result string"


def plain_codes(text):
    """Length, ratios and bucket codes, by the definition."""
    counts = [0] * 512
    for i in range(len(text) - 2):
        key = text[i] * 65536 + text[i + 1] * 256 + text[i + 2]
        counts[key * 2654435761 % 2**32 >> 23] += 1
    q1, q2, q3 = (sorted(counts)[at] for at in (127, 255, 383))
    n = len(text)
    length = n if n < 4 else 4 * (n.bit_length() - 2) + (n >> (n.bit_length() - 3)) % 4
    return length, (15 * q1 // max(1, q3), 15 * q2 // max(1, q3)), [(c > q1) + (c > q2) + (c > q3) for c in counts]


def plain_text(text):
    length, (r1, r2), codes = plain_codes(text)
    return f"{length:02x}{r1:x}{r2:x}" + "".join(f"{4 * a + b:x}" for a, b in zip(codes[::2], codes[1::2]))


def plain_near(a, b):
    (la, ra, ca), (lb, rb, cb) = plain_codes(a), plain_codes(b)
    apart = sum(abs(x - y) for x, y in zip(ca, cb)) + 8 * abs(la - lb) + 4 * sum(abs(x - y) for x, y in zip(ra, rb))
    return 1 - min(apart, 640) / 640


def plain_changes(rows):
    """The walk over rows in order; ties of an id by the hash that Spark takes."""
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = t.encode(), e.encode(), u.encode()
        out.append((i, len(t), hashlib.sha256(b).hexdigest(), plain_text(a), plain_text(b), plain_near(a, b), plain_near(a, c)))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeéfg漢ß", k=rng.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("text", [b"", b"a", b"ab", b"abc", b"abcd" * 9, "é漢😀 ".encode() * 40, bytes(range(1, 128)) * 30])
def test_digest_equals_plain(text):
    own = bd.digest(text)
    assert own.text() == plain_text(text)
    again = bd.parse(own.text())
    assert again.text() == own.text() and (again.codes == own.codes).all()


def test_chunks_do_not_matter(monkeypatch):
    text = prose(random.Random(1), 400).encode()
    want = bd.digest(text).text()
    monkeypatch.setattr(bd, "CHUNK", 7)
    assert bd.digest(text).text() == want


def test_length_code_never_falls():
    codes = [bd.length_code(n) for n in range(5000)]
    assert codes == sorted(codes) and bd.length_code(1 << 40) < 256
    assert bd.length_code(2000) - bd.length_code(1000) == 4


def test_likeness_is_bounded_and_symmetric():
    rng = random.Random(2)
    texts = [b"", b"ab", *[prose(rng, rng.randint(0, 300)).encode() for _ in range(30)]]
    prints = [bd.digest(t) for t in texts]
    for i, a in enumerate(prints):
        assert bd.likeness([a], [a])[0] == 1
        for j, b in enumerate(prints):
            near = bd.likeness([a], [b])[0]
            assert 0 <= near <= 1 and near == bd.likeness([b], [a])[0] == plain_near(texts[i], texts[j])


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_changes_equal_plain_walk(spark, partitions):
    rng = random.Random(partitions)
    ids = rng.sample(range(-50, 500), 60)
    texts = {i: rng.choice(["", "x", prose(rng, rng.randint(1, 80))]) for i in ids}
    texts[ids[0]] = prose(rng, 30_000)
    table = [(i, t or rng.choice(["", None]), 1, "o", "r") for i, t in texts.items()]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = bd.changes(spark.createDataFrame(table, SCHEMA).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert sorted(map(tuple, got)) == sorted(plain_changes(sorted(texts.items())))


def test_null_and_repeated_ids(spark):
    rows = [(1, "one text"), (1, "one text"), (2, None), (2, ""), (None, "no id"), (None, "no id")]
    got = bd.changes(spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA)).collect()
    assert len(got) == 6 and sum(r["doc_id"] is None for r in got) == 2
    ones = [r for r in got if r["doc_id"] == 1]
    assert sorted(r["near_next"] for r in ones) == sorted([1.0, plain_near(b"one text", b"")])
    # The last row without an id is followed by the first row of all.
    tails = {r["edited_sha256"] for r in got if r["doc_id"] is None}
    assert tails == {hashlib.sha256(t.encode()).hexdigest() for t in ("no " + "no", "no " + "on")}


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(5, "abcdef", 0, "", "")], SCHEMA)
    (row,) = bd.changes(one).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and row["near_next"] == 1
    assert bd.changes(one.where("doc_id < 0")).collect() == []
    assert bd.fingerprints(one.where("doc_id < 0")).collect() == []


def test_text_ids(spark):
    rows = spark.createDataFrame([("b", "second text"), ("a", "first text")], "id string, body string")
    got = {r["id"]: r for r in bd.changes(rows, id_col="id", text_col="body").collect()}
    assert got["a"]["edited_sha256"] == hashlib.sha256(b"first" + b"secon").hexdigest()


def test_fingerprints_and_compare_keep_columns(spark):
    rows = spark.createDataFrame([(1, "same words here", 4, "o", "r"), (2, None, 5, None, None)], SCHEMA)
    prints = bd.fingerprints(rows)
    assert {r["doc_id"]: r["fingerprint"] for r in prints.collect()} == {1: plain_text(b"same words here"), 2: plain_text(b"")}
    pairs = rows.join(prints, "doc_id").withColumnRenamed("fingerprint", "row").withColumn("l", F.when(F.col("doc_id") == 1, F.col("row")))
    got = {r["doc_id"]: r for r in bd.compare(pairs, "row", "l", "own").collect()}
    assert set(got[1].asDict()) == {"doc_id", "text", "id", "own", "result", "row", "l"}
    assert got[1]["own"] == 1.0 and got[2]["own"] is None and got[1]["id"] == 4


def test_edits_are_nearer_than_other_texts(spark):
    """Half of a text kept, or every tenth word changed, against texts of the same words."""
    rng = random.Random(3)
    words = [prose(rng, 1) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(60)]
    halves = [" ".join(t.split()[:100] + rng.choices(words, k=100)) for t in texts]
    light = [" ".join(rng.choice(words) if i % 10 == 0 else w for i, w in enumerate(t.split())) for t in texts]
    own, half, lightly = ([bd.digest(t.encode()) for t in x] for x in (texts, halves, light))
    other = own[1:] + own[:1]
    assert (bd.likeness(own, half) > bd.likeness(own, other)).mean() >= 0.95
    assert (bd.likeness(own, lightly) > bd.likeness(own, half)).mean() >= 0.95
