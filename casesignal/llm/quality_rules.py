"""Quality rules: base counts and language-specific perplexity bands.

Spark counts the byte n-grams of all texts by language and gives each of them its
probability under the modified Kneser-Ney model of its language, by aggregates
and joins from order to order. No n-gram is left out: the ``COMMON`` ones that
occur most are broadcast, and what a text has of the others is joined with their
table. Each text gets its log10 perplexity under its own language's model, and each
language a band around the middle half of its texts. A mean over fewer symbols
scatters more, so the band widens with the root of the length below the
language's median length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.llm import kneser_ney as kn
from casesignal.llm.common import arrow_map, arrow_schema, texts_of, to_batch
from casesignal.llm.doc_stats import base_counts
from casesignal.session import stored

#: Distinct n-grams that a task holds before it sends them on.
HELD = 2 << 20
#: N-grams that are broadcast, at most, and how often they occur at least; the others are joined.
COMMON, RARE = 1 << 21, 4
#: Steps of log10 perplexity, and of the log of a length, in the histograms.
FINE, COARSE = 10_000, 100


def languages(docs: DataFrame, lang_col: str = "lang", most: int = 255) -> dict[str | None, int]:
    """Numbers from 1 of the ``most`` languages with the most rows.

    All other languages share the model of number 0; their bands are their own.
    """
    rows = docs.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    top = rows.orderBy(F.desc("n"), F.asc_nulls_last("lang")).limit(most).collect()
    return {r.lang: i for i, r in enumerate(top, 1)}


def _numbers(column: pa.Array, known: dict[str | None, int]) -> list[int]:
    return [known.get(v, 0) for v in column.to_pylist()]


def gram_counts(docs: DataFrame, known: dict[str | None, int], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``gram``, ``n`` over all texts; a task adds up to ``HELD`` n-grams before it sends them."""

    def sent(found: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros(0, dtype=np.int64)
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for found, n in kn.count(texts_of(batch.column(0)), _numbers(batch.column(1), known)):
                grams, at = np.unique(np.concatenate([grams, found]), return_inverse=True)
                total = np.bincount(at, weights=np.concatenate([total, n]), minlength=len(grams)).astype(np.int64)
                if len(grams) > HELD:
                    yield from sent(grams, total)
                    grams, total = grams[:0], total[:0]
        yield from sent(grams, total)

    rows = docs.where(F.length(text_col) > 0).select(F.col(text_col), F.col(lang_col).cast("string"))
    return rows.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _high(gram: Column) -> Column:
    return F.shiftleft(F.shiftright(gram, kn.LANG_SHIFT), kn.LANG_SHIFT)


def _last(order: int) -> Column:
    """The last ``order`` bytes of an n-gram, of the same language."""
    gram = F.col("gram")
    return gram.bitwiseAND(F.lit((1 << (8 * order)) - 1)).bitwiseOR(_high(gram))


def _levels(grams: DataFrame) -> DataFrame:
    """``order``, ``gram``, ``n`` of all orders.

    The highest order has counts, the others the numbers of different bytes
    before an n-gram. Each level is an aggregate of the one above it.
    """
    level, out = grams, grams.withColumn("order", F.lit(kn.ORDER))
    for order in range(kn.ORDER - 1, 0, -1):
        level = level.groupBy(_last(order).alias("gram")).agg(F.count("*").alias("n"))
        out = out.unionByName(level.withColumn("order", F.lit(order)))
    return out


def language_models(docs: DataFrame, known: dict[str | None, int], *, most: int = 1 << 20, text_col: str = "text", lang_col: str = "lang") -> kn.Model:
    """The models of all languages as arrays, for texts that were not counted.

    An order keeps ``most`` n-grams at most, dealt to the languages evenly: up to
    it every n-gram counts; beyond it those below a power of two give their mass
    to the lower order. ``apply_rules`` does not use them.
    """
    spark = docs.sparkSession
    quota = max(1, most // max(1, len(known) + 1))
    grams = stored(gram_counts(docs, known, text_col, lang_col), "byte-grams")
    levels = stored(_levels(grams), "byte-levels")
    lang = F.shiftright("gram", kn.LANG_SHIFT)
    # How many n-grams occur once to four times, and by powers of two: a bounded table.
    few = F.when(F.col("n") <= 4, F.col("n")).otherwise(0)
    kinds: dict[tuple[int, int], list] = {}
    for r in levels.groupBy("order", lang.alias("lang"), (F.length(F.bin("n")) - 1).alias("power"), few.alias("few")).agg(F.count("*").alias("kinds")).collect():
        kinds.setdefault((r.order, r.lang), []).append(r)
    rules = []
    for (order, of), rows in kinds.items():
        once = [sum(r.kinds for r in rows if r.few == i) for i in (1, 2, 3, 4)]
        powers: dict[int, int] = {}
        for r in rows:
            powers[r.power] = powers.get(r.power, 0) + r.kinds
        rules.append((order, of, kn.least_count(powers, quota), *kn.discounts(*once)))
    rules = F.broadcast(spark.createDataFrame(rules, "order int, lang long, least long, d1 double, d2 double, d3 double"))
    context = F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << kn.LANG_SHIFT) - 1)), 8).bitwiseOR(_high(F.col("gram")))
    # The mass of n-grams below the cut stays with their context.
    totals = levels.groupBy("order", context.alias("context")).agg(F.sum("n").alias("total"))
    kept = levels.withColumn("lang", lang).join(rules, ["order", "lang"]).where(F.col("n") >= F.col("least"))
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    kept = kept.select("order", "gram", context.alias("context"), "n", cut.alias("cut")).join(totals, ["order", "context"])
    own = kept.select(F.col("order").cast("byte").alias("order"), "gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("share")).toArrow()
    orders, keys, values = (own.column(c).to_numpy() for c in ("order", "gram", "share"))
    model = kn.Model([], [], [], [])
    for order in range(1, kn.ORDER + 1):
        at = np.flatnonzero(orders == order)
        at = at[np.argsort(keys[at])]
        contexts, back = np.unique(kn.context(keys[at], order), return_inverse=True)
        weights = 1 - np.bincount(back, weights=values[at], minlength=len(contexts))
        for held, new in zip((model.grams, model.shares, model.contexts, model.weights), (keys[at], values[at], contexts, weights), strict=True):
            held.append(new)
    return model


def gram_logs(docs: DataFrame, known: dict[str | None, int], *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``gram``, ``n`` and ``log_p``, the log10 probability of its last byte, of every n-gram of the texts."""
    grams = stored(gram_counts(docs, known, text_col, lang_col), "byte-grams")
    levels = stored(_levels(grams), "byte-levels")
    lang = F.shiftright("gram", kn.LANG_SHIFT)
    seen: dict[tuple[int, int], list[int]] = {}
    for r in levels.groupBy("order", lang.alias("lang")).agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect():
        seen[r.order, r.lang] = [r.n1, r.n2, r.n3, r.n4]
    rules = [(order, of, *kn.discounts(*once)) for (order, of), once in seen.items()]
    rules = F.broadcast(docs.sparkSession.createDataFrame(rules, "order int, lang long, d1 double, d2 double, d3 double"))
    context = F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << kn.LANG_SHIFT) - 1)), 8).bitwiseOR(_high(F.col("gram")))
    # A context has 256 next bytes at most.
    alike = Window.partitionBy("context")
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    lower = None
    for order in range(1, kn.ORDER + 1):
        own = levels.where(F.col("order") == order).withColumn("lang", lang).join(rules, ["order", "lang"])
        own = own.select("gram", "n", context.alias("context"), cut.alias("cut")).withColumns(
            {"total": F.sum("n").over(alike), "lost": F.sum("cut").over(alike)}
        )
        if lower is None:
            below = F.lit(1 / 256)
        else:
            below = F.col("below")
            own = own.withColumn("suffix", _last(order - 1)).join(lower, "suffix")
        p = (F.col("n") - F.col("cut") + F.col("lost") * below) / F.col("total")
        own = own.select("gram", "n", p.alias("p"))
        lower = own.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
    return stored(own.select("gram", "n", F.log10("p").alias("log_p")), "byte-logs")


def common_grams(logs: DataFrame, most: int = COMMON) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count, a power of two from ``RARE``, that ``most`` n-grams or fewer reach; those n-grams, sorted, and their logs."""
    powers = logs.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.count("*").alias("kinds")).collect()
    least = max(RARE, kn.least_count({r.power: r.kinds for r in powers}, most))
    held = logs.where(F.col("n") >= least).select("gram", "log_p").toArrow()
    keys, values = (held.column(c).to_numpy() for c in ("gram", "log_p"))
    at = np.argsort(keys)
    return least, keys[at], values[at]


def scored_texts(
    docs: DataFrame, logs: DataFrame, known: dict[str | None, int], *, most: int = COMMON, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """As ``measures``, of the texts that ``logs`` were made of: every n-gram has its probability.

    One pass adds up the common n-grams of each text and sends on the others;
    these are few, and meet their logs in a join.
    """
    least, *common = common_grams(logs, most)
    sent = docs.sparkSession.sparkContext.broadcast(common)
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, lang_col)]
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType.fromDDL(f"uid bigint, id {kinds[0]}, lang {kinds[1]}, {', '.join(f'{c} bigint' for c in counted)}, scored bigint, log_sum double, gram bigint, times bigint")
    target = arrow_schema(schema)

    def sent_on(**columns: object) -> pa.RecordBatch:
        size = len(columns["uid"])
        return to_batch({f.name: pa.nulls(size, f.type) for f in target} | columns, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, texts = batch.column(0).to_numpy(), texts_of(batch.column(3))
            sums = np.zeros(len(texts))
            for grams, text in kn.windows(texts, _numbers(batch.column(4), known)):
                at, found = pd.factorize(grams, sort=True)
                place = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
                here = keys[place] == found if len(keys) else np.zeros(len(found), dtype=bool)
                own = np.zeros(len(found))
                own[here] = values[place[here]]
                sums += np.bincount(text, weights=own[at], minlength=len(texts))
                rest = np.flatnonzero(~here[at])
                pairs, times = np.unique(text[rest] * max(1, len(found)) + at[rest], return_counts=True)
                for lo in range(0, len(pairs), 100_000):
                    of, gram = np.divmod(pairs[lo : lo + 100_000], len(found))
                    yield sent_on(uid=uid[of], gram=found[gram], times=times[lo : lo + 100_000])
            base = zip(*[base_counts(t) for t in texts], strict=True)
            columns = {n: list(v) for n, v in zip(counted, base, strict=True)}
            yield sent_on(uid=uid, id=batch.column(1), lang=batch.column(2), scored=np.array([len(t) for t in texts], dtype=np.int64), log_sum=sums, **columns)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("name"))
    found = stored(rows.mapInArrow(run, schema), "quality-sums")
    out = found.where("scored IS NOT NULL").drop("gram", "times")
    rest = found.where("gram IS NOT NULL").select("uid", "gram", "times").join(logs.where(F.col("n") < least).select("gram", "log_p"), "gram")
    out = out.join(rest.groupBy("uid").agg(F.sum(F.col("times") * F.col("log_p")).alias("more")), "uid", "left")
    total = F.col("log_sum") + F.coalesce("more", F.lit(0.0))
    return out.select("id", "lang", *counted, "scored", (-total / F.greatest("scored", F.lit(1))).alias("log_ppl"))


def measures(
    docs: DataFrame, model: kn.Model, known: dict[str | None, int], *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``id``, ``lang``, the base counts, ``scored``, ``log_ppl`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(batch: pa.RecordBatch) -> dict[str, object]:
        texts = texts_of(batch.column(2))
        base = [base_counts(t) for t in texts]
        sums = kn.total_log10(sent.value, texts, _numbers(batch.column(3), known))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out = {n: list(v) for n, v in zip(names, zip(*base, strict=True), strict=True)}
        return out | {"id": batch.column(0), "lang": batch.column(1), "scored": sizes, "log_ppl": -sums / np.maximum(sizes, 1)}

    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, lang_col)]
    schema = f"id {kinds[0]}, lang {kinds[1]}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, scored bigint, log_ppl double"
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("name"))
    return arrow_map(rows, of, schema)


def _quantile(rows: DataFrame, value: str, at: float, name: str) -> DataFrame:
    """The least ``value`` of each language with that share of rows at or below.

    ``value`` is a histogram's step, so a language has few of them.
    """
    bins = rows.groupBy("lang", value).agg(F.count("*").alias("n"))
    up = Window.partitionBy("lang").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("n").over(up) >= F.sum("n").over(Window.partitionBy("lang")) * at
    return bins.withColumn("in", share).where("in").groupBy("lang").agg(F.min(value).alias(name))


def bands(rows: DataFrame, reach: float = 3.0) -> DataFrame:
    """``band_lang``, q1, q3, half (of the band, beyond a quartile), usual_size."""
    binned = rows.select("lang", F.floor(F.col("log_ppl") * FINE).alias("p"), F.floor(F.log("scored") * COARSE).alias("s"))
    found = _quantile(binned, "p", 0.25, "q1")
    for value, at, name in (("p", 0.75, "q3"), ("s", 0.5, "size")):
        other = _quantile(binned, value, at, name).withColumnRenamed("lang", "l")
        found = found.join(other, F.col("lang").eqNullSafe(F.col("l"))).drop("l")
    # One step at least: a band is never a point.
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(1))
    return found.select(
        F.col("lang").alias("band_lang"), (F.col("q1") / FINE).alias("q1"), ((F.col("q3") + 1) / FINE).alias("q3"),
        (spread * reach / FINE).alias("half"), F.exp(F.col("size") / COARSE).alias("usual_size"),
    )


def in_band(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` of ``measures`` with kept, band_low and band_high; a language without a band keeps all.

    ``found`` has a row for each language.
    """
    half = F.col("half") * F.greatest(F.lit(1.0), F.sqrt(F.col("usual_size") / F.greatest("scored", F.lit(1))))
    rows = rows.join(found, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    rows = rows.withColumn("band_low", F.col("q1") - half).withColumn("band_high", F.col("q3") + half)
    return rows.withColumn("kept", F.coalesce(F.col("log_ppl").between(F.col("band_low"), F.col("band_high")), F.lit(True)))


def apply_rules(docs: DataFrame, *, reach: float = 3.0, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, base_failed, log_ppl, band and kept of every row.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated
    8-word windows. Other rows are kept inside the band of their language; the
    bands are made of these other rows. A null text has no words and fails. A
    null language is a language of its own, and so are all rows of a table
    without ``lang_col``. Repeated rows count each. Other columns are left out.
    ``common`` n-grams at most are broadcast; results do not depend on it.
    """
    if lang_col not in docs.columns:
        docs = docs.withColumn(lang_col, F.lit(None).cast("string"))
    known = languages(docs, lang_col)
    logs = gram_logs(docs, known, text_col=text_col, lang_col=lang_col)
    rows = scored_texts(docs, logs, known, most=common, id_col=id_col, text_col=text_col, lang_col=lang_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = stored(rows.withColumn("base_failed", failed), "quality-measures")
    rows = in_band(rows, bands(rows.where(~F.col("base_failed")), reach))
    return rows.select(
        F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & F.col("kept")).alias("kept"), "log_ppl", "band_low", "band_high",
    )
