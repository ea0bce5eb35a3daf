"""The stages against plain versions of their decisions."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from casesignal.llm.pieces import load_pieces
from casesignal.llm.registry import piece_model
from tests.llm.test_simhash import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.001"


def plain_lines(rows):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower()
    seen = defaultdict(set)
    for doc, text in rows:
        for x in (text or "").split("\n"):
            seen[key(x)].add(doc)
    return {d: "\n".join(x for x in (t or "").split("\n") if not key(x) or len(seen[key(x)]) < 10) for d, t in rows}


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], SF).write.parquet(f"{tmp_path}/{i}")
        steps.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(s.columns == docs.columns for s in steps[:5])
    raw, good, deduped, single, mixed, encoded = ([tuple(r) for r in s.collect()] for s in steps)
    kept = {r[0] for r in good}
    assert set(good) <= set(raw)
    assert sum((labels[r[0]] == 1) == (r[0] in kept) for r in raw if r[0] in labels) >= 0.9 * sum(r[0] in labels for r in raw)
    want = plain_lines([r[:2] for r in good])
    assert {r[0]: r[1] for r in deduped} == want and all(r[4] == len(r[1]) for r in deduped)
    rows = sorted(deduped)
    groups = plain_groups([plain_fingerprint(r[1]) for r in rows])
    assert sorted(single) == [r for i, r in enumerate(rows) if groups[i] == i]
    # Sources of a mix: weights 1, 2, 3 of all words, at most three times their own.
    own, got = Counter(), Counter()
    for out, rows in ((own, single), (got, mixed)):
        for r in rows:
            out[r[3]] += len(r[1].encode().split())
    times = Counter(r[0] for r in mixed)
    assert max(times.values()) <= 3 and all(got[s] <= 3 * own[s] for s in own)
    texts = {r[0]: r[1] for r in single}
    assert all(r[1] == texts[r[0]] or texts[r[0]].split()[: len(r[1].split())] == r[1].split() for r in mixed)
    plain = load_pieces(piece_model())
    assert Counter((r[0], r[5]) for r in encoded) == Counter((r[0], hashlib.sha256(r[1].encode()).hexdigest()) for r in mixed)
    assert all(hashlib.sha256(plain.decode(r[4])).hexdigest() == r[5] and len(r[4]) == r[3] for r in encoded)


def test_empty_tables_and_nulls(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some words here", None, "a", 15), (2, "some words here", None, "a", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            to = f"{tmp_path}/{name}-{i}"
            stage(spark, table, str(tmp_path)).write.parquet(to)
            table = spark.read.parquet(to)
        assert {"doc_id", "ids", "decoded_sha256"} <= set(table.columns)
