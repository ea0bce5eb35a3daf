"""Scores of the stored tree against a plain tree of dictionaries."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from casesignal.llm import word_tree
from casesignal.llm.registry import op3_suffix_tree
from casesignal.llm.suffix_tree import Tokens
from casesignal.llm.word_tree import learn, score
from tests.llm.test_suffix_tree import words


def plain(train, texts, least, depth):
    count = Counter(w for t in train for w in words(t))
    n, types = sum(count.values()) + len(train), len(count) + bool(train)
    ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
    d = ones / (ones + 2 * twos) if ones else 0.5
    root = count | Counter({" end": len(train)})
    line = lambda t: [" begin", *words(t), " end"]
    after = {}
    for t in train:
        s = line(t)
        for i in range(1, len(s)):
            for k in range(1, min(depth, i) + 1):
                after.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    tree = set()
    for c, own in after.items():
        total = sum(own.values())
        low = after[c[1:]] if len(c) > 1 else root
        if total >= least:
            gain = sum(m * math.log((m / total) / (low[a] / sum(low.values()))) for a, m in own.items())
            if gain > len(own) * math.log(total) / 2:
                tree |= {c[i:] for i in range(len(c))}

    def p(c, a):
        while c and c not in tree:
            c = c[1:]
        if not c:
            return (root[a] - d) / n if root[a] else d * types / n
        own = after[c]
        return (own.get(a, 0) + len(own) * p(c[1:], a)) / (sum(own.values()) + len(own))

    out = []
    for t in texts:
        s, ws = line(t), words(t)
        logs = sum(math.log10(p(tuple(s[max(0, i - depth) : i]), s[i])) for i in range(1, len(s)))
        base = sum(math.log10((c + 1) / (n + types + 1)) for c in [count[w] for w in ws] + [len(train)])
        out.append((len(ws) + 1, sum(count[w] > 0 for w in ws) + bool(train), n, base, logs))
    return out, Counter(len(c) for c in tree)


@pytest.mark.parametrize("hot_share", [1e-9, 0.001, 1.0])
def test_scores_equal_a_plain_tree(spark, hot_share):
    """The last share sends all sequences through the join."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text for r in rows] + ["", None, "the unseenwordé", "the of " * 500]
    ids = list(range(len(texts)))
    train = [t for i, t in zip(ids, texts, strict=True) if i % 3]
    want, states = plain(train, texts, 4, 3)
    assert states[3] > 3
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    tree = learn(df.where("doc_id % 3 <> 0"), least=4, hot_share=hot_share)
    assert {r["depth"]: r["count"] for r in tree.states.groupBy("depth").count().collect()} == states
    got = {r.doc_id: tuple(r)[1:] for r in score(df, tree).collect()}
    for i, w in zip(ids, want, strict=True):
        assert got[i][:3] == w[:3]
        assert got[i][3:] == pytest.approx(w[3:], rel=1e-9, abs=1e-9)


def test_nothing_to_learn_from_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = score(df, learn(df.limit(0))).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 0, 0, 0, 0), (3, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    tree = learn(df)
    assert score(df.limit(0), tree).collect() == [] and score(df, tree).count() == 3


def test_rare_passage_is_learnt_by_the_query(spark, tmp_path):
    """A passage of rare words far below a share of 0.1% scores above its words in another order."""
    filler = [(i, " ".join(f"f{(i * 7 + j * j) % 997}" for j in range(400))) for i in range(300)]
    passage = " ".join(f"p{j}" for j in range(12))
    planted = [(10_000 + i, passage) for i in range(24)]
    mixed = " ".join(f"p{j * 5 % 12}" for j in range(12))
    # crc32 decides who is held out; several copies of each are scored.
    tests = [(20_000 + i, passage) for i in range(8)] + [(30_000, mixed)]
    spark.createDataFrame(filler + planted + tests, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op3_suffix_tree(spark, str(tmp_path)).collect()}
    assert got[20_000].score > got[30_000].score + 12


def test_a_sequence_is_stored_once(spark, monkeypatch):
    """With the counts that give its value, and no second time with that value."""
    rows = []
    keep = word_tree.stored
    monkeypatch.setattr(word_tree, "stored", lambda df, label: rows.append((label, keep(df, label))) or rows[-1][1])
    texts = [(i, " ".join(f"w{(i * j + j) % 23}" for j in range(200))) for i in range(40)]
    learn(spark.createDataFrame(texts, "doc_id long, text string"))
    keys = [df.select("key") for _, df in rows if "n" in df.columns and "key" in df.columns]
    sequences = {(t[i - k : i + 1]) for _, x in texts for t in [(" begin", *x.split(), " end")] for k in (1, 2, 3) for i in range(k, len(t))}
    found = [r.key for df in keys for r in df.collect()]
    assert 0 < len(found) == len(set(found)) <= len(sequences)
    assert not [label for label, _ in rows if label.startswith("values")]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_what_a_worker_holds_does_not_grow_with_its_batch():
    """Rows to look up are sent on slice by slice: a batch of four times the texts takes the same memory."""
    bits = np.full(1 << 7, 0xFFFFFFFF, dtype=np.uint32)
    none = np.array([], dtype=np.int64)
    sent = word_tree.Sent(3, none, none.astype(float), none.astype(float), word_tree.Sieve(12, bits))
    peaks = []
    for n in (2_000, 8_000):
        texts = [" ".join(f"w{(i * 31 + j * j) % 4001}" for j in range(400)) for i in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], ["doc_id", "row", "text"])
        tracemalloc.start()
        rows = [len(part["row"]) for part in word_tree.looked_up(batch, sent, pd.Index(none))]
        peaks.append(tracemalloc.get_traced_memory()[1] - sum(map(len, texts)))
        tracemalloc.stop()
        assert sum(rows) > 1000 * n and max(rows) < 2_000_000
    assert peaks[1] < 1.5 * peaks[0]


def test_words_are_those_of_bytes_split():
    """At both ends of a text, between other white space, and beyond ASCII."""
    texts = ["", " ", " A\x0bB\tc ", "\u00c4b\u00a0c\u2028d  A", "\r\nx\x1cy\x85z\x0c"]
    got = Tokens([t.encode() for t in texts])
    want = [[xxhash.xxh64_intdigest(w) for w in t.encode().lower().split()] for t in texts]
    assert got.lengths.tolist() == [len(w) for w in want]
    assert got.hashes.view(np.uint64)[got.at].tolist() == [h for w in want for h in w]
