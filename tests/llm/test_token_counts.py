"""Counts equal those of the library, also on odd texts."""

import random

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from casesignal.llm.bpe_count import BpeCounter, load_counter
from casesignal.llm.registry import op6_token_counts, piece_model
from casesignal.llm.token_counts import count_tokens

MODEL = piece_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
ODD = ["", " ", "   ", "\n", " \n\n x", "\t\t", "aaaaaaaaaaaaaaaaaaaaa", "ababababab" * 30, "<s>hello</s><0x0A><unk>",
       "▁▁a b", "日本語のテキスト🙂🙂", "a" * 5000, "=" * 777 + "-" * 333, "x\u0000y", "é" * 99, "the the  the   the    the"]


def test_odd_texts_equal_the_library():
    assert load_counter(MODEL).count_texts(ODD) == [len(LIBRARY.encode(t)) for t in ODD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab t\n▁éh.e=0<日🙂", max_size=60), max_size=5))
def test_any_text_equals_the_library(texts):
    assert load_counter(MODEL).count_texts(texts) == [len(LIBRARY.encode(t)) for t in texts]


def test_merging_all_occurrences_equals_one_at_a_time():
    """Vocabularies whose ranks undercut each other, against a plain loop."""
    rng = random.Random(3)
    for _ in range(60):
        pieces = {"a", "b", "c"}
        while len(pieces) < 14:
            x = rng.choice(sorted(pieces)) + rng.choice(sorted(pieces))
            if len(x) <= 6:
                pieces.add(x)
        order = sorted(pieces)
        rng.shuffle(order)
        scored = [(p, -float(i)) for i, p in enumerate(order)]
        rank = {p: i for i, p in enumerate(order)}
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(40)]
        got = BpeCounter(scored).count(words).tolist()
        for w, n in zip(words, got, strict=True):
            s = list(w)
            while True:
                best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in rank), default=None)
                if best is None:
                    break
                s[best[1] : best[1] + 2] = ["".join(s[best[1] : best[1] + 2])]
            assert len(s) == n, (w, order)


def test_rows_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "the the", 9), (None, None, 8), (1, "the the", 9), (2, "", 7)], "doc_id long, text string, n_tokens int")
    rows = sorted(map(tuple, count_tokens(df, MODEL, limit=1).collect()), key=str)
    assert rows == sorted([(1, 7, 2, True), (1, 7, 2, True), (None, 0, 0, False), (2, 0, 0, False)], key=str)
    assert count_tokens(df.limit(0), MODEL).collect() == []


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(LIBRARY.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)
