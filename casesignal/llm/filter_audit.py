"""Filter interaction audit: what each filter removes, in every order of the filters.

A set of filters that have run is a state of the subset lattice; running one
more filter is an edge. What an edge removes depends on its two states alone,
so it is counted once: documents that pass the first state and fail the filter.
Forward counts say in how many orders a state is reached, backward counts in
how many it is left, and an edge lies on their product of orders: this weighs
the edge's removals for the Shapley sums. A step of an order is an edge, so the
table by order reads the same edges.

Documents reach the lattice as counts by (part, set of failed filters, marks);
rows are never held by part or by order.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casesignal.session import stored

#: More filters would make more orders than a table of them is good for.
MOST_FILTERS = 7


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of one text: short, repetitive, shouting, symbols."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def failures(
    docs: DataFrame,
    filters: Mapping[str, Column],
    *,
    duplicate: str | None = None,
    labels: DataFrame | None = None,
    losses: Mapping[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """Counts ``n`` of documents by part, ``mask`` of failed filters, and one 0/1 mark for each loss.

    Bit i of ``mask`` is the i-th filter, ``duplicate`` after all others: that
    filter fails a document whose text equals that of any document of a smaller
    id (a null text equals an empty one). ``losses`` are conditions on columns
    of ``labels``; a document has a mark if any row of its id meets it.

    A null condition passes. A null part is the empty string. A row without an
    id has no marks and is not smaller than, nor later than, any other; rows
    that repeat an id are documents of their own.
    """
    losses = dict(losses or {})
    mask = F.lit(0)
    for i, condition in enumerate(filters.values()):
        mask = mask + _flag(condition) * F.lit(1 << i)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.sha2(text, 256)) if duplicate else F.lit(None).cast("binary")
    # Rows without an id spread out by their text: their own key in the join.
    spread = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), part.alias("part"), key.alias("key"), mask.alias("mask"), spread.alias("spread"))
    rows = rows.groupBy("id", "part", "key", "mask", "spread").agg(F.count(F.lit(1)).alias("n"))
    if labels is not None and losses:
        marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l"), F.lit(0).cast("long").alias("s"))
        marks = marks.agg(*[F.max(_flag(c)).alias(f"lost_{name}") for name, c in losses.items()])
        rows = rows.join(marks, (F.col("id") == F.col("l")) & (F.col("spread") == F.col("s")), "left")
        rows = rows.withColumns({f"lost_{name}": F.coalesce(f"lost_{name}", F.lit(0)) for name in losses})
    else:
        rows = rows.withColumns({f"lost_{name}": F.lit(0) for name in losses})
    kept = ["part", "mask", *[f"lost_{name}" for name in losses]]
    if duplicate is None:
        return rows.groupBy(*kept).agg(F.sum("n").alias("n"))

    # One row for each text, part and mark: how many, and the first id's rows.
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    no_id = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    per_text = stored(rows.groupBy("key", *kept).agg(F.sum("n").alias("n"), no_id.alias("no_id"), first.alias("first")), "texts")
    firsts = per_text.groupBy(F.col("key").alias("k")).agg(F.min("first.id").alias("least"))
    judged = per_text.join(firsts, F.col("key") == F.col("k"))
    passing = F.col("no_id") + F.coalesce(F.when(F.col("first.id") == F.col("least"), F.col("first.n")), F.lit(0))
    both = F.array(
        F.struct(F.lit(0).alias("bit"), passing.alias("n")), F.struct(F.lit(1 << len(filters)).alias("bit"), (F.col("n") - passing).alias("n"))
    )
    split = judged.select(*kept, F.explode(both).alias("e")).where("e.n > 0")
    split = split.withColumn("mask", F.col("mask") + F.col("e.bit")).withColumn("n", F.col("e.n"))
    return split.groupBy(*kept).agg(F.sum("n").alias("n"))


def paths(n: int) -> tuple[dict[int, int], dict[int, int]]:
    """Orders that reach each state from the empty one, and that lead on to the full one."""
    full = (1 << n) - 1
    forward, backward = {0: 1}, {full: 1}
    for state in range(1, full + 1):
        forward[state] = sum(forward[state ^ (1 << i)] for i in range(n) if state >> i & 1)
    for state in range(full - 1, -1, -1):
        backward[state] = sum(backward[state | (1 << i)] for i in range(n) if not state >> i & 1)
    return forward, backward


def edge_counts(counts: DataFrame, n: int, losses: list[str]) -> DataFrame:
    """One row for each part and edge (``state``, ``filter``) of the lattice.

    ``kept``, ``removed``, ``redundant``, ``unique_fails`` and ``<loss>_lost``
    of the edge, and ``orders``: the orders that lead over it.
    """
    forward, backward = paths(n)
    # n * 2^(n-1) edges.
    edges = [(s, i, forward[s] * backward[s | 1 << i]) for s in range(1 << n) for i in range(n) if not s >> i & 1]
    literal = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(i).alias("filter"), F.lit(o).cast("long").alias("orders")) for s, i, o in edges])
    wide = counts.select("*", F.explode(literal).alias("e")).select("*", "e.*").drop("e")
    bit = F.expr("shiftleft(1, filter)")
    fails = F.col("mask").bitwiseAND(bit) != 0
    alive = F.col("mask").bitwiseAND(F.col("state")) == 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return wide.groupBy("part", "state", "filter", "orders").agg(
        total(alive & ~fails).alias("kept"),
        total(alive & fails).alias("removed"),
        total(~alive & fails).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"),
        *[total(alive & fails & (F.col(f"lost_{name}") == 1)).alias(f"{name}_lost") for name in losses],
    )


def audit(
    docs: DataFrame,
    filters: Mapping[str, Column],
    *,
    duplicate: str | None = None,
    labels: DataFrame | None = None,
    losses: Mapping[str, Column] | None = None,
    **columns: str,
) -> DataFrame:
    """One row for each part, order of the filters and step (from 1); see ``failures``.

    Columns: part, filter_order (the filters' names joined), step, kept (after
    the step), removed (in it), redundant (failing its filter, removed before),
    unique_fails (failing its filter only), ``<loss>_lost`` (removed in the step
    with the mark) and shapley (removed by its filter, summed over all orders).
    A table without rows has no parts.
    """
    names = [*filters, *([duplicate] if duplicate else [])]
    if len(names) > MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"at most {MOST_FILTERS} filters of different names")
    marks = list(losses or {})
    counts = failures(docs, filters, duplicate=duplicate, labels=labels, losses=losses, **columns)
    edges = stored(edge_counts(counts, len(names), marks), "edges")
    sums = edges.groupBy(F.col("part").alias("p"), F.col("filter").alias("f"))
    shapley = sums.agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))

    steps = []
    for order in permutations(range(len(names))):
        state = 0
        for at, i in enumerate(order):
            steps.append(("".join(names[j] for j in order), at + 1, state, i))
            state |= 1 << i
    # n! * n rows, whatever the documents.
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, st int, fi int")
    out = edges.join(F.broadcast(steps), (F.col("state") == F.col("st")) & (F.col("filter") == F.col("fi")))
    out = out.join(shapley, (F.col("part") == F.col("p")) & (F.col("filter") == F.col("f")))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley")
