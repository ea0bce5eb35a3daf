"""Language-model scores from a probabilistic suffix tree.

Symbols are the words with a share of ``symbol_share`` or more of the training
tokens, the end of a text, and one class for all other words. A state is a
context of up to two symbols. A context enters the tree if it has a share of
``context_share`` or more and its next symbols diverge from those of its
suffix by more than their number explains; suffixes of states are states. A
state's distribution is smoothed with its suffix's (Witten-Bell), the root is
discounted, and each token is scored in the state of its longest suffix. A word
of the class has the class's probability there, times its share of the class;
unseen words are one symbol with the mass that discounting sets free.

The shares bound what is broadcast: 1 / share rows at most, whatever the
corpus. Words below ``known_share`` find their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casesignal.llm.common import arrow_map, texts_of
from casesignal.session import stored

BEGIN, OTHER, END, FIRST = 0, 1, 2, 3


def held_out(id_col: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


class Tokens:
    """The words of some texts: distinct hashes, and their number at each place."""

    def __init__(self, texts: list[bytes]):
        lower = pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string()))
        # The kernel's white space is that of bytes.split; it gives empty words at a text's ends.
        words = pc.ascii_split_whitespace(lower)
        flat = words.flatten()
        text = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy(zero_copy_only=False))
        real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        coded = flat.filter(pa.array(real)).dictionary_encode()
        digest = xxhash.xxh64_intdigest
        self.hashes = np.array([digest(w) for w in coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)], dtype=np.uint64).view(np.int64)
        self.at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lengths = np.bincount(text[real], minlength=len(texts))

    def symbols(self, symbol: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's symbol with the one and the two before, ends included.

        ``symbol`` gives the symbol of each distinct word.
        """
        starts = np.cumsum(self.lengths + 3) - self.lengths - 3
        line = np.zeros(int((self.lengths + 3).sum()), dtype=np.int64)
        text = np.repeat(np.arange(len(self.lengths)), self.lengths)
        place = np.arange(len(self.at)) + 3 * text + 2
        line[place] = symbol[self.at]
        line[starts + 2 + self.lengths] = END
        real = np.ones(len(line), dtype=bool)
        real[starts] = real[starts + 1] = False
        now = np.flatnonzero(real)
        return line[now], line[now - 1], line[now - 2]


def _slices(batch_texts: list[bytes], size: int = 8 << 20) -> Iterator[tuple[int, list[bytes]]]:
    lo = total = 0
    for i, t in enumerate(batch_texts):
        total += len(t)
        if total >= size:
            yield lo, batch_texts[lo : i + 1]
            lo, total = i + 1, 0
    if lo < len(batch_texts):
        yield lo, batch_texts[lo:]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``h`` (XXH64 of the word), ``c`` of every word of the texts."""

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        tokens = Tokens(texts_of(batch.column(0)))
        return {"h": tokens.hashes, "c": np.bincount(tokens.at, minlength=len(tokens.hashes))}

    rows = arrow_map(docs.select(F.col(text_col)), of, "h bigint, c bigint")
    return rows.groupBy("h").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Root:
    """Counts of all training tokens, and the words known to every task."""

    tokens: int
    types: int
    texts: int
    discount: float
    hashes: np.ndarray
    counts: np.ndarray
    #: Hashes of the words that are symbols, sorted; symbol FIRST + place.
    symbols: np.ndarray
    symbol_counts: np.ndarray

    @property
    def base(self) -> int:
        return FIRST + len(self.symbols)

    def symbol_of(self, hashes: np.ndarray) -> np.ndarray:
        return np.where(_found(self.symbols, hashes), _place(self.symbols, hashes) + FIRST, OTHER)

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probability of a word with that count; 0: of the unseen words."""
        n = max(1, self.tokens)
        unseen = self.discount * self.types / n if self.tokens else 1.0
        return np.where(counts > 0, (counts - self.discount) / n, unseen)

    def distribution(self) -> np.ndarray:
        """Probability of each symbol without a context."""
        out = np.zeros(self.base)
        out[FIRST:] = self.word(self.symbol_counts)
        out[END] = self.word(np.array([self.texts]))[0] if self.texts else 0.0
        out[OTHER] = max(1e-300, 1 - out.sum())
        return out


def _place(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(keys, of), max(0, len(keys) - 1))


def _found(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    return keys[_place(keys, of)] == of if len(keys) else np.zeros(len(of), dtype=bool)


def root(counts: DataFrame, texts: int, *, symbol_share: float = 1e-3, known_share: float = 2.5e-7) -> Root:
    """``counts`` is the stored table of word counts."""
    n, types, ones, twos = (
        int(x or 0) for x in counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    )
    tokens = n + texts
    known = counts.where(F.col("c") >= max(1, tokens * known_share)).toArrow().sort_by("h")
    hashes, c = known.column("h").to_numpy(), known.column("c").to_numpy()
    often = c >= max(1, tokens * symbol_share)
    discount = ones / (ones + 2 * twos) if ones else 0.5
    return Root(tokens, types + (texts > 0), texts, discount, hashes, c, hashes[often], c[often])


def gram_counts(docs: DataFrame, top: Root, text_col: str = "text") -> DataFrame:
    """``gram`` (three symbols as one number), ``n`` over the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(top)

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        own: Root = sent.value
        tokens = Tokens(texts_of(batch.column(0)))
        now, one, two = tokens.symbols(own.symbol_of(tokens.hashes), own.base)
        gram, n = np.unique((two * own.base + one) * own.base + now, return_counts=True)
        return {"gram": gram, "n": n}

    rows = arrow_map(docs.select(F.col(text_col)), of, "gram bigint, n bigint")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"))


def retained(grams: DataFrame, top: Root, context_share: float = 1e-3) -> DataFrame:
    """``depth``, ``context``, ``next``, ``n`` of the contexts in the tree.

    A context stays if n * KL(next | context, next | suffix) exceeds half the
    log of n for each of its next symbols.
    """
    b = top.base
    two = grams.select(F.floor(F.col("gram") / b).alias("context"), (F.col("gram") % b).alias("next"), "n")
    one = two.groupBy((F.col("context") % b).alias("context"), "next").agg(F.sum("n").alias("n"))
    least = top.tokens * context_share

    def tested(rows: DataFrame, below: DataFrame, on: list[str]) -> DataFrame:
        """Contexts whose next symbols diverge from the shares ``q`` in ``below``."""
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= least)
        rows = rows.join(totals, "context").withColumn("suffix", F.col("context") % b)
        gain = F.col("n") * F.log((F.col("n") / F.col("total")) / F.col("q"))
        found = rows.join(below, on).groupBy("context").agg(F.sum(gain).alias("gain"), F.first("total").alias("t"), F.first("kinds").alias("k"))
        return found.where(F.col("gain") > F.col("k") * F.log("t") / 2).select("context")

    whole = one.groupBy("next").agg((F.sum("n") / max(1, top.tokens)).alias("q"))
    sums = one.groupBy("context").agg(F.sum("n").alias("all"))
    shares = one.join(sums, "context").select(F.col("context").alias("suffix"), "next", (F.col("n") / F.col("all")).alias("q"))
    deep = tested(two, shares, ["suffix", "next"])
    flat = tested(one, whole, ["next"])
    flat = flat.unionByName(deep.select((F.col("context") % b).alias("context"))).distinct()
    deep = two.join(deep, "context").withColumn("depth", F.lit(2))
    flat = one.join(flat, "context").withColumn("depth", F.lit(1))
    return deep.unionByName(flat).select("depth", "context", "next", "n")


@dataclass(frozen=True)
class SuffixTree:
    """log10 of each state's distribution, and the state of each pair of symbols."""

    top: Root
    log10: np.ndarray
    state: np.ndarray

    def score(self, now: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.log10[self.state[two, one], now]


def grow(rows: pa.Table, top: Root) -> SuffixTree:
    """The tree of the retained contexts: at most 2 / context_share states."""
    b = top.base
    states = [top.distribution()]
    state = np.zeros((b, b), dtype=np.int32)
    rows = rows.sort_by([("depth", "ascending"), ("context", "ascending"), ("next", "ascending")])
    depth, context, after, n = (rows.column(c).to_numpy() for c in ("depth", "context", "next", "n"))
    edges = np.flatnonzero((np.diff(depth, prepend=-1) != 0) | (np.diff(context, prepend=-1) != 0))
    for lo, hi in zip(edges, np.append(edges, len(depth))[1:], strict=True):
        two, one = divmod(int(context[lo]), b)
        parent = states[0 if depth[lo] == 1 else state[two, one]]
        seen = np.zeros(b)
        seen[after[lo:hi]] = n[lo:hi]
        kinds = hi - lo
        # BEGIN is never a next symbol.
        own = (seen + kinds * parent) / (seen.sum() + kinds)
        if depth[lo] == 1:
            state[:, one] = len(states)
        else:
            state[two, one] = len(states)
        states.append(own)
    with np.errstate(divide="ignore"):
        return SuffixTree(top, np.log10(np.array(states)), state)


def learn(docs: DataFrame, *, text_col: str = "text", symbol_share: float = 1e-3, context_share: float = 1e-3, known_share: float = 2.5e-7) -> tuple[SuffixTree, DataFrame]:
    """The tree of all rows of ``docs``, and the stored table of word counts."""
    counts = stored(word_counts(docs, text_col), "word-counts")
    top = root(counts, docs.count(), symbol_share=symbol_share, known_share=known_share)
    grams = stored(gram_counts(docs, top, text_col), "grams")
    return grow(retained(grams, top, context_share).toArrow(), top), counts


def score(docs: DataFrame, tree: SuffixTree, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, n_known, train_tokens, base_score, score of each row.

    A null text has one token, its end. Rows that repeat are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tree)

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        own: SuffixTree = sent.value
        top = own.top
        ends = np.array([top.texts])
        class_log = np.log10(top.distribution()[OTHER])
        parts: list[tuple] = []
        for _, texts in _slices(texts_of(batch.column(1))):
            tokens = Tokens(texts)
            text = np.repeat(np.arange(len(texts)), tokens.lengths)
            known = _found(top.hashes, tokens.hashes)
            count = np.where(known, top.counts[_place(top.hashes, tokens.hashes)] if len(top.hashes) else 0, 0)
            symbol = top.symbol_of(tokens.hashes)
            add = lambda v: np.bincount(text, weights=v[tokens.at], minlength=len(texts))
            base = add(np.where(known, np.log10(count + 1), 0.0)) + np.log10(ends[0] + 1)
            now, one, two = tokens.symbols(symbol, top.base)
            of_text = np.repeat(np.arange(len(texts)), tokens.lengths + 1)
            logs = np.bincount(of_text, weights=own.score(now, one, two) if top.tokens else None, minlength=len(texts)) if top.tokens else np.zeros(len(texts))
            logs = logs + add(np.where((symbol == OTHER) & top.tokens, (np.log10(top.word(count)) * known) - class_log, 0.0))
            rare = ~known[tokens.at]
            parts.append((tokens.lengths + 1, add(known.astype(float)) + (ends[0] > 0), base, logs, tokens.hashes[tokens.at[rare]], np.bincount(text[rare], minlength=len(texts))))
        size, have, base, logs, hashes, rare = (np.concatenate(x) for x in zip(*parts, strict=True))
        offsets = np.concatenate([[0], np.cumsum(rare)]).astype(np.int32)
        return {
            "id": batch.column(0), "n_tokens": size, "have": have.astype(np.int64), "base": base, "logs": logs,
            "rare": pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes, pa.int64())),
        }

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, have bigint, base double, logs double, rare array<bigint>"
    rows = arrow_map(docs.select(F.col(id_col), F.col(text_col)), of, schema)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    # Words too rare for the broadcast: each holds a share below known_share.
    top = tree.top
    rare = rows.select("row", F.explode("rare").alias("h"))
    found = rare.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    unseen = top.discount * top.types / max(1, top.tokens) if top.tokens else 1.0
    own = F.when(F.col("c") > 0, F.log10((F.col("c") - top.discount) / max(1, top.tokens))).otherwise(float(np.log10(unseen)))
    found = found.groupBy(F.col("row").alias("r")).agg(
        F.sum(F.log10(F.col("c") + 1)).alias("more_base"), F.sum(own).alias("more_logs"), F.count_if(F.col("c") > 0).alias("more_have")
    )
    rows = rows.drop("rare").join(found, F.col("row") == F.col("r"), "left")
    whole = float(np.log10(top.tokens + top.types + 1))
    zero = F.lit(0.0)
    return rows.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("have") + F.coalesce("more_have", F.lit(0))).alias("n_known"),
        F.lit(top.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("logs") + F.coalesce("more_logs", zero)).alias("score"),
    )
