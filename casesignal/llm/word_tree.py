"""Scores from a suffix tree whose symbols are all words, kept as stored tables.

A sequence of words is keyed by its 64-bit cyclic hash: the key turned left by
``TURN`` and xored with the next word's XXH64. A state is a context of up to
``depth`` words that occurs ``least`` times or more and whose next words diverge
from those of its suffix by more than their number explains; suffixes of states
are states. ``least`` is a count, so what is learnt grows with the corpus. A
state's distribution is smoothed with its suffix's (Witten-Bell), the root is
discounted, and each word is scored in the state of its longest suffix.

Contexts are counted level by level: a context of d words is counted if its
first d - 1 words occur often enough with the last one. A bitmap of bounded size
holds their keys; what it lets through wrongly only costs time, since counts and
joins are exact.

The log of a word's probability is a sum over the sequences that end at it:

    log p0(w) + sum over the states c before w of
        log of the mass that c leaves to its suffix, or, if w was seen after c,
        log p(w | c) - log p(w | suffix of c)

so a text's score is the sum of one value for each sequence in it. A sequence is
stored once, with its count and those of its suffixes, which with the totals of
its states give its value. Values of sequences that hold a share of ``hot_share`` or more are sent to every task
(4 / hot_share at most); the others are joined to each text's distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casesignal.llm.common import arrow_map, arrow_parts, texts_of
from casesignal.llm.suffix_tree import Tokens, _found, _slices, word_counts
from casesignal.session import stored

TURN = 23
#: No word holds a space.
BEGIN, END = (int(np.uint64(xxhash.xxh64_intdigest(b)).astype(np.int64)) for b in (b" begin", b" end"))
#: The bitmap has 2**28 bits at most, 32 MB.
MAX_BITS = 28
#: Sequences with that share of the tokens are dealt over so many parts.
SALT_SHARE, SALTS = 2.5e-4, 16
#: Bytes of text whose sequences a worker holds at a time.
SLICE = 2 << 20


def _turned(keys: np.ndarray, times: int) -> np.ndarray:
    by = TURN * times % 64
    k = keys.view(np.uint64)
    return ((k << np.uint64(by)) | (k >> np.uint64(64 - by))).view(np.int64) if by else keys


def _then(context: Column, word: Column) -> Column:
    """Key of the sequence ``context`` followed by ``word``."""
    turned = F.shiftleft(context, TURN).bitwiseOR(F.shiftrightunsigned(context, 64 - TURN))
    return turned.bitwiseXOR(word)


@dataclass(frozen=True)
class Sieve:
    """A bitmap that lets all its keys through, and some others."""

    bits: int
    words: np.ndarray

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for shift in (0, 32):
            at = (keys >> shift) & ((1 << self.bits) - 1)
            out &= (self.words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) > 0
        return out


def sieve(keys: DataFrame) -> Sieve:
    """``keys`` is a table with one column ``key``."""
    n = keys.count()
    bits = min(MAX_BITS, max(12, (16 * n).bit_length()))
    at = F.explode(F.array(*[F.shiftright("key", s).bitwiseAND(F.lit((1 << bits) - 1)) for s in (0, 32)]))
    marks = keys.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("i"))
    found = marks.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 AS int))")).alias("b")).toArrow()
    words = np.zeros(1 << (bits - 5), dtype=np.uint32)
    words[found.column("i").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    return Sieve(bits, words)


def _sequences(tokens: Tokens, most: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Text and place of each symbol, and keys of the 1 to ``most`` symbols that end there.

    A text is BEGIN, its words, END. Keys that reach before BEGIN mean nothing:
    a key of k symbols holds from place k - 1 on.
    """
    size = tokens.lengths + 2
    starts = np.cumsum(size) - size
    text = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(text)) - starts[text]
    line = np.zeros(len(text), dtype=np.int64)
    line[(place > 0) & (place < size[text] - 1)] = tokens.hashes[tokens.at]
    line[starts], line[starts + size - 1] = BEGIN, END
    keys = [line]
    for k in range(1, most):
        longer = keys[-1].copy()
        longer[k:] ^= _turned(line[:-k], k) if k < len(line) else line[:0]
        keys.append(longer)
    return text, place, keys


def _counted(keys: np.ndarray, *others: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct ``keys``, the values beside each, and its occurrences or the sum of ``n``."""
    at, found = pd.factorize(keys)
    first = np.empty(len(found), dtype=np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    return found, *(x[first] for x in others), np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)


def gram_counts(docs: DataFrame, depth: int, allowed: Sieve, below: DataFrame, least_hot: float, text_col: str = "text") -> DataFrame:
    """``key``, ``c``, ``s``, ``n``, ``m0`` ...: each sequence of a context of ``depth`` words and the next one.

    Without ``key`` for ``depth`` 1, see ``_keyed``.

    ``s`` is the key of the sequence without its first word, found in ``below``
    with its own counts, the longest first. Rows are dealt by ``s`` before they
    are summed, so that the sums meet ``below`` where they are; those of an
    ``s`` with a count of ``least_hot`` or more are dealt over SALTS parts.
    """
    spark = docs.sparkSession
    hot = np.sort(below.where(F.col("m0" if depth == 1 else f"m{depth - 1}") >= least_hot).select("s").toArrow().column("s").to_numpy())
    sent = spark.sparkContext.broadcast((allowed, hot))

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        sieved, often = sent.value
        parts = []
        for _, texts in _slices(texts_of(batch.column(0)), SLICE):
            _, place, keys = _sequences(Tokens(texts), depth + 1)
            now = np.flatnonzero(place >= depth)
            now = now[sieved.passes(keys[depth - 1][now - 1])]
            parts.append(_counted(keys[depth][now], keys[depth - 1][now - 1], keys[depth - 1][now]))
        key, c, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:
            key, c, s, n = _counted(key, c, s, n=n)
        # Equal suffixes in a row take little room in a shuffle.
        by = np.argsort(s)
        key, c, s, n = key[by], c[by], s[by], n[by]
        return {"key": key, "c": c, "s": s, "n": n, "salt": np.where(_found(often, s), c % SALTS, 0)}

    rows = arrow_map(docs.select(F.col(text_col)), of, "key bigint, c bigint, s bigint, n bigint, salt bigint")
    if depth == 1:
        rows = rows.drop("key")
    first = [] if depth == 1 else [F.min("key").alias("key")]
    rows = rows.repartition("s", "salt").groupBy("s", "salt", "c").agg(*first, F.sum("n").alias("n"))
    counts = [c for c in below.columns if c != "s"]
    most = F.col(f"m{depth - 1}")
    salts = F.when(most >= least_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
    below = below.withColumn("salt", F.explode(salts))
    return rows.join(below, ["s", "salt"]).select(*([] if depth == 1 else ["key"]), "c", "s", "n", *counts)


def _keyed(grams: DataFrame) -> DataFrame:
    """``grams`` with ``key``, which is not stored where it follows from two words."""
    return grams if "key" in grams.columns else grams.withColumn("key", _then(F.col("c"), F.col("s")))


@dataclass(frozen=True)
class Sent:
    """What every task gets: values of the hot sequences, the bitmap of the states."""

    depth: int
    keys: np.ndarray
    score: np.ndarray
    base: np.ndarray
    states: Sieve


@dataclass(frozen=True)
class WordTree:
    """``values``: key, score, base, n of all sequences with a value; ``states``: key, depth, total, kinds."""

    tokens: int
    types: int
    unseen: float
    values: DataFrame
    states: DataFrame
    least_hot: float
    sent: Sent


@contextmanager
def _releasing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each job go when it ends; the stored tables are what later ones read."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def learn(docs: DataFrame, *, text_col: str = "text", least: int = 8, depth: int = 3, hot_share: float = 2e-6) -> WordTree:
    """The tree of all rows of ``docs``."""
    with _releasing(docs.sparkSession):
        return _learn(docs, text_col, least, depth, hot_share)


def _learn(docs: DataFrame, text_col: str, least: int, depth: int, hot_share: float) -> WordTree:
    spark = docs.sparkSession
    counts = stored(word_counts(docs, text_col), "word-counts")
    n, types, ones, twos = (
        int(x or 0) for x in counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    )
    texts = docs.count()
    tokens, types = n + texts, types + (texts > 0)
    discount = ones / (ones + 2 * twos) if ones else 0.5
    unseen = float(np.log10(discount * types / tokens)) if tokens else 0.0
    ends = spark.createDataFrame([(END, texts)] if texts else [], "w bigint, c bigint")
    root = counts.select(F.col("h").alias("w"), "c").unionByName(ends)

    # Counts of each level, and the contexts that diverge from their suffix.
    grams: list[DataFrame] = []
    contexts: list[DataFrame] = []
    begin = spark.createDataFrame([(BEGIN,)] if texts >= least else [], "key bigint")
    below, totals = root.select(F.col("w").alias("s"), F.col("c").alias("m0")), None
    candidates = counts.where(F.col("c") >= least).select(F.col("h").alias("key")).unionByName(begin)
    for d in range(1, depth + 1):
        own = stored(gram_counts(docs, d, sieve(candidates), below, max(least, tokens * SALT_SHARE), text_col), f"grams-{d}")
        own = _keyed(own)
        found = own.groupBy("c").agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log(F.col("n") / F.col(f"m{d - 1}"))).alias("x")
        ).where(F.col("total") >= least)
        if d == 1:
            found = found.select("*", F.lit(0).cast("long").alias("u"), F.lit(max(1, tokens)).alias("above"))
        else:
            # A context is a sequence of the level below, and its suffix that one's.
            found = found.join(often.select(F.col("key").alias("c"), F.col("s").alias("u")), "c").join(totals, "u")
        gain = F.col("x") - F.col("total") * F.log(F.col("total") / F.col("above"))
        found = stored(found.select("c", "u", "total", "kinds", (gain > F.col("kinds") * F.log("total") / 2).alias("diverges")), f"contexts-{d}")
        grams.append(own)
        contexts.append(found)
        below = own.select(F.col("key").alias("s"), F.col("n").alias(f"m{d}"), *[f"m{i}" for i in range(d)])
        totals = found.select(F.col("c").alias("u"), F.col("total").alias("above"))
        often = own.where(F.col("n") >= least)
        candidates = often.select("key")

    kept: list[DataFrame] = []
    for found in reversed(contexts):
        keep = found.where("diverges").select("c")
        if kept:
            keep = keep.unionByName(kept[0].select(F.col("u").alias("c"))).distinct()
        kept.insert(0, stored(found.join(keep, "c", "left_semi").drop("diverges"), "states"))
    # Each state with the totals and kinds of its suffixes.
    states: list[DataFrame] = []
    for d, own in enumerate(kept, 1):
        own = own.withColumnsRenamed({"total": f"t{d}", "kinds": f"k{d}"})
        if d > 1:
            own = stored(own.join(states[-1].drop("u").withColumnRenamed("c", "u"), "u"), "states")
        states.append(own)

    # Values: the counts of a sequence and its suffixes give its probability.
    zero = F.lit(0.0).alias("base")
    q = lambda count: (count - discount) / max(1, tokens)
    parts = [counts.select(F.col("h").alias("w"), "c").unionByName(ends).select(
        F.col("w").alias("key"), (F.log10(q(F.col("c"))) - unseen).alias("score"), F.log10(F.col("c") + 1).alias("base"), F.col("c").alias("n")
    )]
    for d, (own, state) in enumerate(zip(grams, states, strict=True), 1):
        p = q(F.col("m0"))
        for i in range(1, d + 1):
            short, n = p, F.col("n" if i == d else f"m{i}")
            p = (n + F.col(f"k{i}") * p) / (F.col(f"t{i}") + F.col(f"k{i}"))
        left = F.log10(F.col(f"k{d}") / (F.col(f"t{d}") + F.col(f"k{d}")))
        rows = own.drop("s").join(state.drop("u"), "c")
        parts.append(rows.select("key", (F.log10(p) - F.log10(short) - left).alias("score"), zero, "n"))
        parts.append(state.select(F.col("c").alias("key"), left.alias("score"), zero, F.col(f"t{d}").alias("n")))
    values = parts[0]
    for more in parts[1:]:
        values = values.unionByName(more)

    least_hot = max(1.0, tokens * hot_share)
    hot = values.where(F.col("n") >= least_hot).groupBy("key").agg(F.sum("score").alias("score"), F.sum("base").alias("base")).toArrow().sort_by("key")
    every = None
    for d, state in enumerate(states, 1):
        one = state.select(F.col("c").alias("key"), F.lit(d).alias("depth"), F.col(f"t{d}").alias("total"), F.col(f"k{d}").alias("kinds"))
        every = one if every is None else every.unionByName(one)
    sent = Sent(depth, *(hot.column(c).to_numpy() for c in ("key", "score", "base")), sieve(every.select("key")))
    return WordTree(tokens, types, unseen, values, every, least_hot, sent)


#: Kinds of rows: a sequence to look up, and the four figures of a text.
LOOK_UP, SIZE, HAVE, BASE, LOGS = range(5)


def looked_up(batch: pa.RecordBatch, own: Sent, hot_keys: pd.Index) -> Iterator[dict[str, object]]:
    """The rows of a batch of ``id``, ``row`` and text, by slices of the texts.

    A sequence takes far more room as a row than in a text, so that a slice's
    rows go on their way before the next slice is cut.
    """
    # The last, 0, is for those not found.
    base_of, score_of = np.append(own.base, 0.0), np.append(own.score, 0.0)
    for lo, texts in _slices(texts_of(batch.column(2)), SLICE):
        row = batch.column(1).to_numpy()[lo : lo + len(texts)]
        tokens = Tokens(texts)
        text, place, keys = _sequences(tokens, own.depth + 1)
        of_text, of_key, state = [], [], None
        for k, found in enumerate(keys):
            # A value has a sequence that follows a state or is one.
            before, state = state, own.states.passes(found) if k < own.depth else np.zeros(len(found), dtype=bool)
            at = np.flatnonzero((place >= k) & (state | np.concatenate([[False], before[:-1]]))) if k else np.arange(len(found))
            of_text.append(text[at])
            of_key.append(found[at])
        of_text, of_key = np.concatenate(of_text), np.concatenate(of_key)
        of_key, distinct = pd.factorize(of_key)
        place = hot_keys.get_indexer(distinct)
        add = lambda v: np.bincount(of_text, weights=v[place][of_key], minlength=len(texts))  # noqa: B023, E731
        figures = {SIZE: tokens.lengths + 1, HAVE: add((base_of > 0).astype(float)), BASE: add(base_of), LOGS: add(score_of)}
        # A text's distinct sequences that are not hot, and their number.
        cold = place[of_key] < 0
        pair, n = np.unique(of_text[cold] * max(1, len(distinct)) + of_key[cold], return_counts=True)
        by_text, by_key = np.divmod(pair, max(1, len(distinct)))
        at = np.concatenate([np.full(len(pair), -1), *[lo + np.arange(len(texts))] * len(figures)])
        yield {
            "id": batch.column(0).take(pa.array(at, mask=at < 0)),
            "row": np.concatenate([row[by_text], *[row] * len(figures)]),
            "key": np.concatenate([distinct[by_key], *[row] * len(figures)]),
            "kind": np.concatenate([np.full(len(pair), LOOK_UP), *[np.full(len(texts), f) for f in figures]]),
            "v": np.concatenate([n.astype(float), *figures.values()]),
        }


def score(docs: DataFrame, tree: WordTree, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, n_known, train_tokens, base_score, score of each row.

    A null text has one token, its end. Rows that repeat are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tree.sent)
    index: list[pd.Index] = []

    def of(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
        if not index:
            # Its hash table is made once a task, not once a batch.
            index.append(pd.Index(sent.value.keys))
        return looked_up(batch, sent.value, index[0])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), F.col(text_col))
    rows = arrow_parts(rows, of, f"id {kind}, row bigint, key bigint, kind int, v double")
    rest = tree.values.where(F.col("n") < tree.least_hot).drop("n").withColumnRenamed("key", "of")
    found = rows.join(rest, (F.col("key") == F.col("of")) & (F.col("kind") == LOOK_UP), "left")
    figure = lambda at, more: F.sum(F.when(F.col("kind") == at, F.col("v")).when(F.col("kind") == LOOK_UP, more))
    sums = found.groupBy("row").agg(
        F.max("id").alias(id_col),
        F.sum(F.when(F.col("kind") == SIZE, F.col("v"))).cast("long").alias("n_tokens"),
        figure(HAVE, F.when(F.col("base") > 0, F.col("v"))).cast("long").alias("n_known"),
        figure(BASE, F.col("v") * F.col("base")).alias("base"),
        figure(LOGS, F.col("v") * F.col("score")).alias("logs"),
    )
    whole = float(np.log10(tree.tokens + tree.types + 1))
    return sums.select(
        id_col, "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("logs") + F.col("n_tokens") * tree.unseen).alias("score"),
    )
