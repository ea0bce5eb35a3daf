"""The audit against every document walked through every order."""

import random
import re
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from casesignal.llm.filter_audit import audit, failures, paths, text_filters

SCHEMA = "doc_id long, text string, source string, n int, part string, mask string, key int"
LABELS = "doc_id long, quality int, toxic int, part string"


def plain_fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
    ]


def plain(rows, labels):
    good = {i for i, q, *_ in labels if i is not None and q == 1}
    toxic = {i for i, _, t, *_ in labels if i is not None and t == 1}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    facts = {}
    for i, t, s, *_ in rows:
        fails = [*plain_fails(t or ""), i is not None and i > least[t or ""]]
        facts.setdefault(s or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, own in facts.items():
        removed_in = dict.fromkeys(range(5), 0)
        for order in permutations(range(5)):
            left = list(range(len(own)))
            for step, f in enumerate(order):
                gone = [d for d in left if own[d][0][f]]
                left = [d for d in left if not own[d][0][f]]
                fails = sum(own[d][0][f] for d in range(len(own)))
                only = sum(own[d][0][f] and sum(own[d][0]) == 1 for d in range(len(own)))
                removed_in[f] += len(gone)
                row = (len(left), len(gone), fails - len(gone), only, sum(own[d][1] for d in gone), sum(own[d][2] for d in gone))
                out[part, "".join("ABCDE"[j] for j in order), step + 1] = row
        for (p, o, s), row in list(out.items()):
            if p == part:
                out[p, o, s] = (*row, removed_in["ABCDE".index(o[s - 1])])
    return out


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 7, "p", "m", 1) for r in rows], SCHEMA)
    marks = spark.createDataFrame([(*r, "x") for r in labels], LABELS)
    losses = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    got = audit(docs, text_filters(F.col("text")), duplicate="E", labels=marks, losses=losses).collect()
    assert len({tuple(r[:3]) for r in got}) == len(got)
    return {tuple(r[:3]): tuple(r[3:]) for r in got}


def texts(rng):
    words = ["plain", "Word", "LOUD", "x#y", "50%", "é", "漢", "next\x1fword"]
    few, many = rng.choices(words, k=rng.randint(1, 8)), [f"w{i}" for i in range(rng.choice([150, 199, 200, 260]))]
    return rng.choice([None, "", " \t\n", " ".join(few), "\t".join(many), " ".join(many + few), " ".join(few * 60), "\x0b".join(many).upper()])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_every_order_walked(spark, seed):
    rng = random.Random(seed)
    pool = [texts(rng) for _ in range(12)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(pool), rng.choice([None, "", "a", "b", "B"])) for _ in range(80)]
    rows += rows[:9]
    labels = [(rng.choice([None, *range(45)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(40)]
    assert run(spark, rows, labels) == plain(rows, labels)


def test_hot_text_many_parts(spark):
    """A text that a third of all rows share, over many parts; its first document stays."""
    rows = [(i, "same text", f"s{i % 50}") for i in range(900)] + [(1000 + i, f"own text {i}", "s1") for i in range(1800)]
    counts = failures(spark.createDataFrame(rows, "doc_id long, text string, source string"), {}, duplicate="E").collect()
    assert sum(r["n"] for r in counts if r["mask"] == 1) == 899
    assert sum(r["n"] for r in counts) == 2700
    assert {r["part"]: r["n"] for r in counts if r["mask"] == 1}["s0"] == 17


def test_limits_of_each_filter(spark):
    """Exactly 200 words, half of them distinct, two capitals in a hundred characters."""
    rows = [(i, " ".join(f"w{j}" for j in range(n)), "s") for i, n in enumerate((199, 200, 201))]
    rows += [(i + 10, " ".join(f"w{j % d}" for j in range(200)), "s") for i, d in enumerate((99, 100, 101))]
    rows += [(i + 20, "A" * n + "b" * (100 - n), "s") for i, n in enumerate((1, 2, 3))]
    assert run(spark, rows, [(i, 1, 1) for i in range(0, 30, 2)]) == plain(rows, [(i, 1, 1) for i in range(0, 30, 2)])


def test_long_text(spark):
    text = " ".join(f"word{i % 90_000}" for i in range(200_000))
    rows = [(1, text, "s"), (2, text, "s")]
    got = run(spark, rows, [(2, 1, 0)])
    assert got == plain(rows, [(2, 1, 0)])


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, "a", "s")], []) == plain([(1, "a", "s")], [])


def test_fewer_filters_without_labels(spark):
    rows = spark.createDataFrame([(1, 3), (2, 8), (3, None)], "doc_id long, v int").withColumn("text", F.lit("t")).withColumn("source", F.lit("s"))
    got = {(r["filter_order"], r["step"]): r for r in audit(rows, {"low": F.col("v") < 5, "odd": F.col("v") % 2 == 1}).collect()}
    assert set(got) == {("lowodd", 1), ("lowodd", 2), ("oddlow", 1), ("oddlow", 2)}
    assert (got["lowodd", 1]["removed"], got["lowodd", 2]["redundant"], got["oddlow", 2]["removed"]) == (1, 1, 0)
    assert got["lowodd", 1]["shapley"] == 1 and "good_lost" not in got["lowodd", 1].asDict()
    with pytest.raises(ValueError):
        audit(rows, {str(i): F.lit(True) for i in range(9)})


@pytest.mark.parametrize("n", [0, 1, 5])
def test_paths_count_all_orders(n):
    forward, backward = paths(n)
    full = (1 << n) - 1
    assert forward[full] == backward[0] == factorial(n)
    for state in forward:
        size = state.bit_count()
        assert (forward[state], backward[state]) == (factorial(size), factorial(n - size))


def test_shapley_adds_up(spark):
    """Over all filters the sums give every document that any filter removes, once an order."""
    rng = random.Random(9)
    rows = [(i, texts(rng), "s") for i in range(60)]
    got = run(spark, rows, [])
    order = {k[1]: v for k, v in got.items()}
    assert len(order) == 120
    sums = {k[1][k[2] - 1]: v[-1] for k, v in got.items()}
    kept = got["s", "ABCDE", 5][0]
    assert sum(sums.values()) == 120 * (60 - kept)
