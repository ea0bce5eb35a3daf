"""No n-gram is left out of the models, however few are broadcast."""

import pytest

from casesignal.llm import quality_rules as qr
from tests.llm.test_quality import SAMPLE, plain_kneser_ney


@pytest.mark.parametrize("common", [0, 5, 60, 1 << 20])
def test_rest_of_the_n_grams_is_joined(spark, common):
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in [*SAMPLE, "a " * 40 + "the"] for lang in ("xx", "yy"))]
    df = spark.createDataFrame(rows + [(0, "the same id", "xx"), (None, None, "xx")], "doc_id long, text string, lang string").repartition(3)
    got = qr.apply_rules(df, common=common).collect()
    want = []
    for lang in ("xx", "yy"):
        texts = [t.encode() for _, t, x in rows if x == lang] + ([b"the same id"] if lang == "xx" else [])
        want += [(lang, -s / max(1, len(t))) for t, s in zip(texts, plain_kneser_ney(texts)[1], strict=True)]
    assert len(got) == len(rows) + 2
    have = sorted((r.lang, r.log_ppl) for r in got)
    assert have == [(lang, pytest.approx(v, abs=1e-9)) for lang, v in sorted([*want, ("xx", 0.0)])]
