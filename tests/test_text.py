"""Name normalisers and scalar expressions on hand-built rows."""

import pytest
import xxhash
from pyspark.sql import functions as F

from casesignal.functions import bits, scalars, text
from casesignal.functions.vocab import CASE_AGE_BINS, CONTEXT_AGE_BINS


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, make, kind="string"):
    rows = one_column(spark, values, kind).select("i", make(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_fold_and_key(spark):
    values = [None, "", "-", " ab-cd_ef ", "a  b", "\xa0x\t"]
    assert apply(spark, values, text.fold_separators) == [None, "", " ", "AB CD EF", "A  B", "X"]
    assert apply(spark, values, text.lookup_key) == [None, "", "", "AB CD EF", "A  B", "X"]


def test_std_name(spark):
    values = [None, '"a  b"', "a\\b", "\xa0a \tb\x1f", '"', '""x""', ' " a "']
    expected = [None, "A B", "A\\B", "A B", "", '"X"', " A "]
    assert apply(spark, values, text.std_name) == expected
    assert apply(spark, [None], lambda c: text.std_name(c, "NONE")) == ["NONE"]


def test_first_token(spark):
    assert apply(spark, ["", "  a b", "a\tb", "one"], text.first_token) == ["", "a", "a", "one"]


def test_contains_any_is_literal_and_unanchored(spark):
    make = lambda c: text.contains_any(c, ["ASPART", "A+B"])
    assert apply(spark, [None, "AMPHETAMINE ASPARTATE", "AAB", "XA+BX"], make) == [False, True, False, True]


def test_split_tags(spark):
    got = apply(spark, [None, "", "A;B", "A,|B", "A; ;B;", ";"], text.split_tags)
    assert got == [[], [], ["A", "B"], ["A", "B"], ["A", "B"], []]


def test_null_if_na(spark):
    make = lambda c: text.null_if_na(c, ("", "NA", "NULL"))
    assert apply(spark, ["NA", "", "NULL", "na", None, "x"], make) == [None, None, None, "na", None, "x"]


def test_dates(spark):
    make = lambda c: scalars.parse_date(c).cast("string")
    assert apply(spark, ["20250131", "202504", "junk", None, "20250230"], make) == ["2025-01-31", None, None, None, None]


@pytest.mark.parametrize("bins", [CONTEXT_AGE_BINS, CASE_AGE_BINS])
def test_cut_is_right_closed(spark, bins):
    edges, labels = bins
    got = apply(spark, [float(e) for e in edges] + [edges[-1] + 1.0, None], lambda c: scalars.cut(c, *bins), "double")
    assert got == [None, *labels, None, None]


def test_cut_edge_18(spark):
    assert apply(spark, [0.0, 18.0, 18.5], lambda c: scalars.cut(c, *CASE_AGE_BINS), "double") == ["<18", "<18", "18-40"]


def test_flags_and_ratio(spark):
    assert apply(spark, [None, "ps", "SS"], lambda c: scalars.equals_flag(c, "PS")) == [0, 1, 0]
    assert apply(spark, [None, "Intramuscular", "oral"], lambda c: scalars.pattern_flag(c, "SUBCUTANEOUS|SC|SUBCUT")) == [0, 1, 0]
    assert apply(spark, [0.0, 4.0, None], lambda c: scalars.ratio(F.lit(2), c), "double") == [None, 0.5, None]


def test_to_number(spark):
    values = ["1", " 2.5 ", "5D", "NaN", "1e3", "-.5", "", None, "x"]
    assert apply(spark, values, scalars.to_number) == [1.0, 2.5, None, None, 1000.0, -0.5, None, None, None]


def test_hashed_bits_by_xxhash64(spark):
    texts = ["añb😀c", "abcabc", "the quick brown fox", "x" * 5000]

    def plain(t, nbits):
        grams = {t[i : i + 3].encode() for i in range(len(t) - 2)}
        signed = [h - (1 << 64) if h >> 63 else h for h in (xxhash.xxh64_intdigest(g, 42) for g in grams)]
        return sorted({h % nbits for h in signed})

    for nbits in (64, 1000, 1024):
        assert apply(spark, texts, lambda c, n=nbits: bits.hashed_bits(c, n, 3)) == [plain(t, nbits) for t in texts]


def test_hashed_bits(spark):
    got = apply(spark, [None, "", "ab", "abcabc", "añb😀c"], lambda c: bits.hashed_bits(c, 64, 3))
    assert got[:3] == [[], [], []]
    assert len(got[3]) <= 3 and got[3] == sorted(set(got[3]))
    grams = apply(spark, ["añb😀c"], lambda c: bits.char_ngrams(c, 3))
    assert grams == [["añb", "ñb😀", "b😀c"]]
