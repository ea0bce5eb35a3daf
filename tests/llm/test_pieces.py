"""The path of the highest score over the model's pieces, and round trips."""

import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from casesignal.llm import pieces
from casesignal.llm.pieces import MARK, decode, distinct_words, encode, load_pieces
from casesignal.llm.registry import op8_pieces, piece_model

MODEL = piece_model()
ODD = ["", None, " ", "   x", "\n", "\n\n a\nb", "the the\tthe", "日本語🙂 text", "\x00 odd", "a" * 500, "thereforenothing" * 40,
       "Donaudampfschifffahrtsgesellschaft.", "▁ mark", "==== ---- ####", "é" * 70]


def library():
    """The model's pieces under the library's unigram search."""
    proto = pb.ModelProto()
    proto.ParseFromString(MODEL)
    proto.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def total(ids):
    proto = pb.ModelProto()
    proto.ParseFromString(MODEL)
    return sum(proto.pieces[i].score for i in ids)


@pytest.mark.parametrize("max_bytes", [128 << 20, 0])
def test_odd_texts_round_trip(spark, max_bytes):
    """The second bound sends the words through the join."""
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] * 2, "doc_id long, text string, pieces string")
    got = encode(df, MODEL, max_bytes=max_bytes).select("doc_id", "text", "pieces.*")
    plain = load_pieces(MODEL)
    rows = decode(got, MODEL).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        text = r.text or ""
        want = [i for w in plain.words(text) for i in plain.word_ids(w)]
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded == text.replace("▁", " ")
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert encode(df.limit(0), MODEL, max_bytes=max_bytes).collect() == []


def test_plain_path_has_the_highest_score():
    """Against all ways to cut short words, and the library's path."""
    lib, plain = library(), load_pieces(MODEL)

    def best(w):
        ways = [sum(plain.scores.get(p, plain.unknown if len(p) == 1 else float("-inf")) for p in cut) for cut in cuts(w)]
        return max(ways)

    def cuts(w):
        return [[w]] * bool(w) + [[w[:i], *rest] for i in range(1, len(w)) for rest in cuts(w[i:])] if w else [[]]

    for t in ["the", "thing", "there a", "Hello", "wollten", "être"]:
        for w in plain.words(t):
            assert total(plain.word_ids(w)) == best(w)
        assert total([i for w in plain.words(t) for i in plain.word_ids(w)]) >= total(lib.encode(t))


def test_query_is_no_worse_than_the_library(spark):
    sf = "/root/testdata/sf0.001"
    lib = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op8_pieces(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert total(r.ids) >= total(lib.encode(texts[r.doc_id]))
        assert lib.decode(r.ids) == texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_words_end_where_no_piece_goes_on(spark):
    """A stop, a digit or a foreign letter behind a word makes no new word, and the ids are those of the text uncut."""
    own = load_pieces(MODEL)
    texts = [f"shant{end}" for end in (".", ",", "***", "!!", "7", "42", "\u0436", "\n", " ")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = [r.w for r in distinct_words(df, MODEL).collect()]
    assert len(words) == len(set(words)) and sum("shant" in w for w in words) == 1
    rng = random.Random(8)
    texts += ["".join(rng.choice("ab.,1 \n\r\u2014\u201d\u00bb\u00e9\u6f22\u0436\u2581#(\U0001f600") for _ in range(rng.randrange(40))) for _ in range(300)]
    for t in texts:
        whole = (MARK + t).replace(" ", MARK) if t else ""
        assert "".join(own.words(t)) == whole
        assert [i for w in own.words(t) for i in own.word_ids(w)] == own.word_ids(whole)


def test_cuts_are_the_same_in_windows_of_any_length(monkeypatch):
    plain = load_pieces(MODEL)
    texts = [(t or "").encode() for t in ODD]
    want, lengths = plain.cut(texts)
    assert lengths.tolist() == [len(plain.words(t or "")) for t in ODD] and lengths.sum() == len(want)
    for size in (1, 2, 7):
        monkeypatch.setattr(pieces, "WINDOW", size)
        words, got = plain.cut(texts)
        assert words.equals(want) and got.tolist() == lengths.tolist()


def test_words_beyond_the_broadcast_are_encoded_where_they_stand(spark):
    """No text is shuffled, whichever words the broadcast has room for, and the ids are the same."""
    texts = ["the common words " * 5 + f"rare{i} \U0001f600{i} \u6f22{i}" for i in range(40)] + ["", "x" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    want = {r.doc_id: r.pieces for r in encode(df, MODEL).collect()}
    words = distinct_words(df, MODEL)
    some = pieces.commonest(words, 600)
    assert 0 < some.count() < words.count() and "\u2581the" in {r.w for r in some.collect()}
    for max_bytes in (0, 600):
        out = encode(df.coalesce(1), MODEL, max_bytes=max_bytes)
        assert {r.doc_id: r.pieces for r in out.collect()} == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_the_lattice_of_many_words_is_the_recurrence_of_each():
    own, rng = load_pieces(MODEL), random.Random(4)
    words = [w for t in ODD if t for w in own.words(t)] + ["", "\U0001f600", "a\u0416\U0001f600b"]
    words += ["".join(rng.choice("abcdeinrst\u2581 =\u00e9\u6f22\u0436\U0001f600\n") for _ in range(rng.randrange(1, 70))) for _ in range(400)]
    lengths, ids = own.lattice(words)
    want = [own.word_ids(w) for w in words]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert own.lattice([])[1].tolist() == []
