"""Scores against a plain tree of dictionaries."""

import math
import re
import zlib
from collections import Counter

import pytest

from casesignal.llm.registry import op3_suffix_tree
from casesignal.llm.suffix_tree import learn, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def plain(train, texts, symbol_share, context_share):
    count = Counter(w for t in train for w in words(t))
    n, types = sum(count.values()) + len(train), len(count) + bool(train)
    ones, twos = (sum(c == k for c in count.values()) for k in (1, 2))
    d = ones / (ones + 2 * twos) if ones else 0.5
    often = {w for w, c in count.items() if c >= max(1, n * symbol_share)}

    def p_word(w):
        return (count[w] - d) / n if count[w] else d * types / n

    root = {w: p_word(w) for w in often} | {"END": (len(train) - d) / n}
    root["OTHER"] = 1 - sum(root.values())

    def symbols(t):
        return ["", "", *[w if w in often else "OTHER" for w in words(t)], "END"]

    grams = {0: Counter(), 1: Counter(), 2: Counter()}
    for t in train:
        s = symbols(t)
        for i in range(2, len(s)):
            for k in (0, 1, 2):
                grams[k][tuple(s[i - k : i]), s[i]] += 1
    after = {}
    for k in grams:
        for (c, a), m in grams[k].items():
            after.setdefault(c, {})[a] = m
    tree = set()
    for c, own in after.items():
        total = sum(own.values())
        if c and total >= n * context_share:
            low = after[c[1:]]
            gain = sum(m * math.log((m / total) / (low[a] / sum(low.values()))) for a, m in own.items())
            if gain > len(own) * math.log(total) / 2:
                tree |= {c[i:] for i in range(len(c))}

    def p(c, a):
        while c and c not in tree:
            c = c[1:]
        if not c:
            return root[a]
        own = after[c]
        return (own.get(a, 0) + len(own) * p(c[1:], a)) / (sum(own.values()) + len(own))

    out = []
    for t in texts:
        s, ws = symbols(t), words(t)
        logs = sum(math.log10(p(tuple(s[i - 2 : i]), s[i])) for i in range(2, len(s)))
        logs += sum(math.log10(p_word(w) / root["OTHER"]) for w in ws if w not in often)
        base = sum(math.log10((c + 1) / (n + types + 1)) for c in [count[w] for w in ws] + [len(train)])
        out.append((len(ws) + 1, sum(count[w] > 0 for w in ws) + bool(train), n, base, logs))
    return out, len(tree)


@pytest.mark.parametrize("known_share", [1e-9, 0.004])
def test_scores_equal_a_plain_tree(spark, known_share):
    """The second share sends most words through the join."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text for r in rows] + ["", None, "the unseenwordé", "the of " * 2000]
    ids = list(range(len(texts)))
    train = [t for i, t in zip(ids, texts, strict=True) if i % 3]
    want, states = plain(train, texts, 0.005, 0.005)
    assert states > 3
    df = spark.createDataFrame([(i, t, 1.0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, score double")
    tree, counts = learn(df.where("doc_id % 3 <> 0"), symbol_share=0.005, context_share=0.005, known_share=known_share)
    assert len(tree.log10) == states + 1
    got = {r.doc_id: tuple(r)[1:] for r in score(df, tree, counts).collect()}
    for i, w in zip(ids, want, strict=True):
        assert got[i][:3] == w[:3]
        assert got[i][3:] == pytest.approx(w[3:], rel=1e-9, abs=1e-9)


def test_states_are_distributions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tree, _ = learn(df, symbol_share=0.01)
    assert (10**tree.log10).sum(axis=1) == pytest.approx(1.0)


def test_nothing_to_learn_from_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    tree, counts = learn(df.limit(0))
    rows = score(df, tree, counts).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 0, 0, 0, 0), (3, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    tree, counts = learn(df)
    assert score(df.limit(0), tree, counts).collect() == [] and score(df, tree, counts).count() == 3


def test_query_beats_unigrams_on_held_out_texts(spark):
    got = op3_suffix_tree(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + len(held)
