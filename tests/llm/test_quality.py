"""Rules and classifier against plain computations and held-out labels."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casesignal.llm import kneser_ney as kn
from casesignal.llm import quality_rules as qr
from casesignal.llm.boosting import fit
from casesignal.llm.doc_stats import FEATURES, base_counts, features
from casesignal.llm.quality_model import held_out, keep_good, score, train
from casesignal.llm.quality_rules import apply_rules
from casesignal.llm.registry import op5_quality_rules, op9_quality_model

SF = "/root/testdata/sf0.001"


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


ODD = ["", " ", "a", "a b c d e f g h " * 3, "x " * 7, "x " * 8, "x " * 9, "é b c\n\n é b c\né b c", "#|<> **\r\n$$\r\n", "  a\x1cb", "z" * 30000]


@pytest.mark.parametrize("text", ODD)
def test_base_counts(text):
    assert base_counts(text.encode()) == plain_base(text)
    assert len(features(text.encode())) == len(FEATURES) and all(map(math.isfinite, features(text.encode())))


def plain_kneser_ney(texts):
    """log10 probability of each text of a language by dictionaries, from the definition."""
    top = kn.ORDER
    seqs = [[kn.BEGIN] * (top - 1) + list(t) for t in texts]
    levels = {top: Counter(tuple(s[i - top + 1 : i + 1]) for s in seqs for i in range(top - 1, len(s)))}
    for k in range(top - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {k: kn.discounts(*[sum(n == i for n in v.values()) for i in (1, 2, 3, 4)]) for k, v in levels.items()}
    total, lost = defaultdict(int), defaultdict(float)
    for k, v in levels.items():
        for g, n in v.items():
            total[g[:-1], k] += n
            lost[g[:-1], k] += cut[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        if not total[g[:-1], k]:
            return p(g[1:])
        n = levels[k][g]
        own = n - cut[k][min(n, 3) - 1] if n else 0
        return own / total[g[:-1], k] + lost[g[:-1], k] / total[g[:-1], k] * p(g[1:])

    return p, [sum(math.log10(p(tuple(s[i - top + 1 : i + 1]))) for i in range(top - 1, len(s))) for s in seqs]


SAMPLE = ["the theme of the then", "Other #1 thing\n", "", "\x00\x01 odd", "\u00e9\u00e0\u00fc the", "then" * 9]


def number(text, lang):
    return int.from_bytes(text, "big") | lang << kn.LANG_SHIFT


def test_models_equal_the_definition(spark):
    rows = [(t, lang) for t in SAMPLE for lang in ("xx", "yy", None)] + [("only here, of one language", "yy")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    known = qr.languages(df)
    assert sorted(known.values()) == [1, 2, 3] and known["yy"] == 1
    model = qr.language_models(df, known)
    for lang, of in known.items():
        texts = [t.encode() for t, x in rows if x == lang]
        p, want = plain_kneser_ney(texts)
        assert np.allclose(kn.total_log10(model, texts, [of] * len(texts)), want)
        unseen = b"zzz quite new"
        padded = bytes([kn.BEGIN]) * 5 + unseen
        own = [p(tuple(padded[i : i + 6])) for i in range(len(unseen))]
        assert np.allclose(kn.total_log10(model, [unseen], [of]), sum(map(math.log10, own)))


@pytest.mark.parametrize("most", [4, 60, 1 << 20])
def test_cut_models_are_distributions(spark, most):
    df = spark.createDataFrame([(t, "xx") for t in SAMPLE], "text string, lang string")
    model = qr.language_models(df, qr.languages(df), most=most)
    assert all(len(g) <= most for g in model.grams) and all(len(g) <= most for g in model.contexts)
    for before in (b"e the", b"then ", b"zzzzz", b"\xff\xff\xff\xff\xff"):
        every = np.array([number(before + bytes([b]), 1) for b in range(256)], dtype=np.int64)
        assert model.probability(every).sum() == pytest.approx(1)


def test_stretches_do_not_change_n_grams():
    texts, langs = [t.encode() for t in SAMPLE] * 3, [1, 2, 0] * 6
    whole = [np.concatenate(x) for x in zip(*kn.windows(texts, langs), strict=True)]
    for size in (1, 3, 7, 40):
        parts = [np.concatenate(x) for x in zip(*kn.windows(texts, langs, size), strict=True)]
        assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    want = [number((bytes([kn.BEGIN]) * 5 + t)[i : i + 6], lang) for t, lang in zip(texts, langs, strict=True) for i in range(len(t))]
    assert whole[0].tolist() == want
    assert list(kn.windows([], [])) == [] and kn.total_log10(kn.Model([[]] * 6, [[]] * 6, [[]] * 6, [[]] * 6), [b""], [0]).tolist() == [0.0]


def test_cut_is_the_least_that_fits():
    kinds = {0: 100, 1: 40, 2: 9, 5: 1}
    assert [kn.least_count(kinds, m) for m in (1000, 150, 149, 50, 10, 9, 1, 0)] == [1, 1, 2, 2, 4, 32, 32, 64]
    assert kn.least_count({}, 5) == 1


def test_rare_languages_share_a_model(spark):
    df = spark.createDataFrame([(f"text {i}", f"l{i % 4}") for i in range(10)], "text string, lang string")
    assert qr.languages(df, most=2) == {"l0": 1, "l1": 2}
    grams = [r.gram >> kn.LANG_SHIFT for r in qr.gram_counts(df, qr.languages(df, most=2)).collect()]
    assert set(grams) == {0, 1, 2}


def test_word_order_and_language_matter(spark):
    """Nine in ten texts stay; shuffled words and another language's model reject most."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = docs.join(op5_quality_rules(spark, "/root/testdata/sf0.01").where(~F.col("base_failed")).select("doc_id"), "doc_id")
    rng = np.random.default_rng(3)
    rows = good.select("doc_id", "text", "lang").collect()
    langs = sorted({r.lang for r in rows})
    some = [rows[i] for i in rng.choice(len(rows), 150, replace=False)]
    odd = [(-1 - i, " ".join(rng.permutation(r.text.split())), r.lang) for i, r in enumerate(some)]
    odd += [(-1000 - i, r.text, langs[(langs.index(r.lang) + 1) % len(langs)]) for i, r in enumerate(some)]
    # The odd texts are judged by the models of the good ones.
    known = qr.languages(good)
    model = qr.language_models(good, known)
    judged = qr.measures(spark.createDataFrame(odd, "doc_id long, text string, lang string"), model, known)
    own = qr.measures(good.select("doc_id", "text", "lang"), model, known)
    kept = {r.id: r.kept for r in qr.in_band(judged.unionByName(own), qr.bands(own)).collect()}
    share = lambda ids: np.mean([kept[i] for i in ids])
    assert share([r.doc_id for r in rows]) >= 0.9
    assert share([i for i in kept if -1000 < i < 0]) <= 0.5
    assert share([i for i in kept if i <= -1000]) <= 0.1


def test_rules_query_equals_plain(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op5_quality_rules(spark, SF).collect()}
    texts = [(r.text or "").encode() for r in rows]
    logs = [0.0] * len(rows)
    for lang in {r.lang for r in rows}:
        at = [i for i, r in enumerate(rows) if r.lang == lang]
        for i, value in zip(at, plain_kneser_ney([texts[i] for i in at])[1], strict=True):
            logs[i] = value
    groups = defaultdict(list)
    assert len(got) == len(rows)
    for r, t, s in zip(rows, texts, logs, strict=True):
        g, want = got[r.doc_id], plain_base(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert g.log_ppl == pytest.approx(-s / max(1, len(t)))
        if not g.base_failed:
            groups[r.lang].append((g, len(t)))
        else:
            assert not g.kept
    for own in groups.values():
        p = sorted(math.floor(g.log_ppl * 10000) for g, _ in own)
        at = lambda x, q: x[math.ceil(len(x) * q) - 1]
        q1, q3 = at(p, 0.25), at(p, 0.75)
        usual = math.exp(at(sorted(math.floor(math.log(n) * 100) for _, n in own), 0.5) / 100)
        for g, n in own:
            half = max(q3 - q1, 1) * 3.0 / 10000 * max(1, math.sqrt(usual / n))
            assert g.kept == (q1 / 10000 - half <= g.log_ppl <= (q3 + 1) / 10000 + half)


def test_rules_on_odd_rows(spark):
    df = spark.createDataFrame([(i, t, None, 5) for i, t in enumerate(ODD)] + [(None, None, "en", 5)] * 2 + [(99, "plain words here " * 9, "en", 5)], "doc_id long, text string, lang string, n_words int")
    got = apply_rules(df).collect()
    assert len(got) == len(ODD) + 3 and sum(r.doc_id is None for r in got) == 2
    assert apply_rules(df.limit(0)).collect() == []
    bare = apply_rules(df.drop("lang")).collect()
    assert len(bare) == len(got) and {r.lang for r in bare} == {None}
    clash = df.withColumn("gram", F.lit(1)).withColumn("id", F.lit("x")).withColumn("kept", F.lit(False)).withColumn("name", F.lit(0))
    assert sorted(map(str, apply_rules(clash).collect())) == sorted(map(str, got))


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op9_quality_model(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000
    held = [(r.predicted, labels[d]) for d, r in got.items() if r.held_out and d in labels]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_flat_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = fit(x, y, trees=20, depth=3)
    out = []
    for row in x[:50]:
        total = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            for _ in range(3):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - 7]
        out.append(1 / (1 + math.exp(-total)))
    assert np.allclose(trees.scores(x[:50]), out)
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.9


def test_classifier_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words", 0.1), (1, "good words", 0.1), (None, None, 0.2), (3, "### $$$", 0.3)], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    trees = train(docs, labels)
    assert score(docs, trees).count() == 4
    assert train(docs, labels.limit(0)) is None
    assert keep_good(docs, labels.limit(0)).count() == 4 and keep_good(docs, labels).columns == docs.columns
    assert score(docs.limit(0), trees).collect() == []
    assert [r[0] for r in docs.select(held_out(F.col("doc_id"))).collect()] == [zlib.crc32(b"1") % 4 == 2] * 2 + [False, zlib.crc32(b"3") % 4 == 2]
