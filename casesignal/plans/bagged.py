"""Random forests of many labels at once, grown level by level on histograms.

Every (label, tree) is a model. A level of a batch of models is a few jobs: each
task counts, for the nodes it is asked for, the bagged positives and negatives
of its rows by node, drawn feature and code, and the counts meet in a tree
reduction. Where a group stands in every tree stays with the cached groups.

Bags are Poisson draws by hash of row and tree, so a tree's bag is the same for
every label and in every run. Rows of equal codes are one group, whose bagged
positives and negatives are counted once for a batch. Classes are balanced within each bag: counts are
whole numbers, and the weights of a bag's own classes are put on when splits are
compared.

Where the distinct codes are few enough (``gathered.MOST``) no job is run for a
level: every task holds them all and grows whole trees of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casesignal.operators.binned import CODES, Binning, code_counts, distinct_codes, encode, fit_binning, unpack
from casesignal.operators.trees import Trees
from casesignal.plans.boost import DIRECT, NO_FOLD, Block, mixed, narrow, salt, spread, summed, tallied, to_blocks
from casesignal.plans.gathered import MOST, Gathered, gather
from casesignal.session import stored

#: Models grown together; distinct codes hold some six bytes for each.
BATCH = 256
#: Counts that a task sends at a time, at most.
CELLS = 2_000_000
#: Bytes that a task takes to count all groups for the models it grows together, at most.
TOGETHER = 1 << 26
#: All features are looked at in a node, not the drawn ones alone, if they are at most so many times as many.
ALL = 4
#: Trees of a label that a task grows together, at most.
TREES = 32
#: Share of rows drawn at most 0, 1, 2 ... times.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
_TINY = 1e-9


@dataclass(frozen=True)
class Settings:
    """``depth``: levels at most, None for no limit. A tree tries the square
    root of the features at a node, and more only while none of them splits it."""

    trees: int = 500
    least: int = 1
    depth: int | None = None
    seed: int = 42


def bag(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree's bag holds each row."""
    u = (mixed(key.view(np.uint64) ^ salt(seed, tree, 3)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(_POISSON, u, side="right")


def bag_weights(positive: np.ndarray, negative: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a bag's classes: rows / (2 rows of the class); 0 for an absent class."""
    n = positive + negative
    return tuple(np.where(c > 0, n / np.maximum(2 * c, 1), 0.0) for c in (positive, negative))


@dataclass
class Standing:
    """A block's groups of equal rows, for some models.

    ``at`` is a group's node in each model's tree, ``drawn`` how many of its
    positives and negatives are in the bag: (2, group, model).
    """

    codes: np.ndarray
    at: np.ndarray
    drawn: np.ndarray


def _start(block: Block, label: np.ndarray, tree: np.ndarray, seed: int) -> Standing:
    groups = len(block.codes)
    drawn = np.zeros((2, groups, len(label)), dtype=np.int64)
    for t in np.unique(tree):
        times = bag(block.key, seed, int(t))
        for m in np.flatnonzero(tree == t):
            drawn[:, :, m] = tallied(block.group, groups, block.labels[:, label[m]] == 1, times)
    return Standing(block.codes, np.zeros((groups, len(label)), dtype=np.int32), narrow(drawn))


@dataclass
class Moves:
    """Rows of the nodes that were split go to a child: a picklable task.

    ``splits`` has a row (model, node, feature, code, left child) for each, in
    the order of models.
    """

    splits: np.ndarray
    ordered: np.ndarray
    fill: np.ndarray

    def __call__(self, block: Standing) -> Standing:
        at = block.at.copy()
        edges = np.flatnonzero(np.diff(self.splits[:, 0], prepend=-1, append=-1))
        width = int(max(self.splits[:, 1].max(), at.max(initial=0))) + 1
        for lo, hi in zip(edges, edges[1:], strict=False):
            m = int(self.splits[lo, 0])
            which = np.full(width, -1, dtype=np.int64)
            which[self.splits[lo:hi, 1]] = np.arange(lo, hi)
            own = which[at[:, m]]
            rows = np.flatnonzero(own >= 0)
            _, _, feature, code, left = self.splits[own[rows]].T
            held = block.codes[rows, feature].astype(np.int64)
            held = np.where(held == 0, self.fill[feature], held)
            at[rows, m] = left + np.where(self.ordered[feature], held > code, held == code)
        return replace(block, at=at)


#: Cells that rows are in, in order, and their positives and negatives: (2, cell).
Cells = tuple[np.ndarray, np.ndarray]


@dataclass
class Tally:
    """Counts for some nodes: row i of ``features`` belongs to ``nodes[i]``.

    Cells are the codes of each node's features, one after another; those without
    a row are not sent. The task carries small numbers only: it is sent to every block.
    """

    models: np.ndarray
    nodes: np.ndarray
    features: np.ndarray
    sizes: np.ndarray

    def start(self) -> tuple[np.ndarray, int]:
        """First cell of each feature of each node, and the cells in all."""
        size = self.sizes[self.features.ravel()].astype(np.int64)
        ends = np.cumsum(size)
        return (ends - size).reshape(self.features.shape), int(ends[-1])

    def __call__(self, blocks: Iterator[Standing]) -> Iterator[Cells]:
        found = [self.counts(block) for block in blocks]
        if found:
            yield merged(*found)

    def counts(self, block: Standing) -> Cells:
        start, cells = self.start()
        width = int(max(self.nodes.max(), block.at.max(initial=0))) + 1
        at, sums = [np.zeros(0, dtype=np.int64)], [np.zeros((2, 0), dtype=np.int32)]
        edges = np.flatnonzero(np.diff(self.models, prepend=-1, append=-1))
        for lo, hi in zip(edges, edges[1:], strict=False):
            m = int(self.models[lo])
            slot = np.full(width, -1, dtype=np.int64)
            slot[self.nodes[lo:hi]] = np.arange(lo, hi)
            own = slot[block.at[:, m]]
            rows = np.flatnonzero((own >= 0) & block.drawn[:, :, m].any(axis=0))
            if not len(rows):
                continue
            cell = start[own[rows]] + block.codes[rows[:, None], self.features[own[rows]]]
            first, last = int(start[lo, 0]), int(start[hi, 0]) if hi < len(start) else cells
            cell = (cell - first).ravel()
            sides = [
                np.bincount(cell, weights=np.repeat(n, cell.size // len(rows)), minlength=last - first).astype(np.int32)
                for n in block.drawn[:, rows, m].astype(np.float64)
            ]
            met = np.flatnonzero(sides[0] + sides[1])
            at.append(first + met)
            sums.append(np.stack(sides)[:, met])
        return np.concatenate(at), np.concatenate(sums, axis=1)


def merged(*parts: Cells) -> Cells:
    """One entry for each cell of the parts, in order."""
    if len(parts) == 1:
        return parts[0]
    at, sums = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], np.add.reduceat(sums[:, order], first, axis=1, dtype=np.int32) if len(at) else sums


def gathered(parts: RDD) -> Cells | None:
    """The cells of all tasks; None if no task has a block."""
    found = parts.collect() if parts.getNumPartitions() <= DIRECT else [parts.treeReduce(merged, depth=2)]
    return merged(*found) if found else None


def node_features(usable: np.ndarray, seed: int, model: np.ndarray, node: np.ndarray, attempt: np.ndarray, k: int) -> np.ndarray:
    """Features that nodes try: the ``attempt``-th ``k`` of a walk over all usable ones.

    The walk starts and strides by hash; no feature comes twice before all have come.
    """
    n = len(usable)
    strides = np.array([s for s in range(1, n + 1) if math.gcd(s, n) == 1])
    h = mixed(mixed(model.astype(np.uint64) ^ salt(seed, 4)) ^ node.astype(np.uint64))
    first = (h % np.uint64(n)).astype(np.int64)
    stride = strides[(mixed(h) % np.uint64(len(strides))).astype(np.int64)]
    at = attempt[:, None] * k + np.arange(k)[None, :]
    return usable[(first[:, None] + stride[:, None] * at) % n]


@dataclass
class Counted:
    """Counts of some nodes' features: ``feature[i]`` of node ``slot[i]`` has the cells from ``start[i]`` on.

    A node's features are in the order drawn. ``single`` marks nodes that no feature splits.
    """

    cells: Cells
    start: np.ndarray
    feature: np.ndarray
    slot: np.ndarray
    single: np.ndarray


def compare(counts: Counted, models: np.ndarray, weights: np.ndarray, ordered: np.ndarray, fill: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Per node, of model ``models``: gain (0 if none), feature, code, counts of the left side and of the right one.

    The gain is the weighted Gini decrease; among equal gains the feature drawn
    first and the lowest code win. A code without a row parts as the one before
    it does, or not at all, so only cells that rows are in are compared.
    """
    slots, start, drawn = len(models), counts.start, counts.feature
    out = tuple(np.zeros(slots, dtype=kind) for kind in (np.float64, *[np.int64] * 6))
    cell, sums = counts.cells
    if not len(cell):
        return out
    of = np.searchsorted(start, cell, side="right") - 1
    missing = (cell == start[of]) & (fill[drawn[of]] > 0)
    if missing.any():
        # Missing codes first, then the others: both are in order.
        cell, sums = merged((cell[missing] + fill[drawn[of[missing]]], sums[:, missing]), (cell[~missing], sums[:, ~missing]))
        of = np.searchsorted(start, cell, side="right") - 1
    pos, neg = sums.astype(np.int64)
    code, slot = cell - start[of], counts.slot[of]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    held = np.cumsum(np.diff(of, prepend=-1) != 0) - 1
    sides = []
    for c in (pos, neg):
        running = np.cumsum(c)
        before = running[first] - c[first]
        whole = np.add.reduceat(c, first)[held]
        left = np.where(ordered[drawn[of]], running - before[held], whole - c)
        sides.append((left, whole - left))
    (pl, pr), (nl, nr) = sides
    w = weights[:, models]
    gl, gr = w[0][slot] * pl, w[0][slot] * pr
    hl, hr = gl + w[1][slot] * nl, gr + w[1][slot] * nr
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl**2 / hl + gr**2 / hr - (gl + gr) ** 2 / (hl + hr)
    fits = (pl + nl >= least) & (pr + nr >= least) & (code > 0)
    gain = 2 * np.where(fits & np.isfinite(gain), gain, -1.0)
    there, begin = np.unique(slot, return_index=True)
    top = np.zeros(slots)
    top[there] = np.maximum.reduceat(gain, begin)
    near = np.flatnonzero(gain >= (top - np.abs(top) * _TINY)[slot])
    _, at = np.unique(slot[near], return_index=True)
    at = near[at]
    found = np.where(top[there] > _TINY, top[there], 0.0), drawn[of[at]], code[at], pl[at], nl[at], pr[at], nr[at]
    for held_out, values in zip(out, found, strict=True):
        held_out[there] = values
    return out


class ByJobs:
    """Where the groups of cached blocks stand: every count is a job."""

    def __init__(self, blocks: RDD, label: np.ndarray, tree_of: np.ndarray, seed: int):
        self.groups = blocks.map(lambda block: len(block.codes)).sum()
        self.held = blocks.map(partial(_start, label=label, tree=tree_of, seed=seed)).persist(StorageLevel.MEMORY_AND_DISK)
        self.before: RDD | None = None

    def keep(self, active: np.ndarray) -> None:
        pass

    def count(self, _: int, rows: np.ndarray, features: np.ndarray, sizes: np.ndarray) -> Counted | None:
        tally = Tally(rows[:, 0].astype(np.int32), rows[:, 1].astype(np.int32), features.astype(np.uint16), sizes.astype(np.int32))
        counts = gathered(self.held.mapPartitions(tally))
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        slot = np.repeat(np.arange(len(rows)), features.shape[1])
        return counts and Counted(counts, tally.start()[0].ravel(), features.ravel(), slot, np.zeros(len(rows), dtype=bool))

    def totals(self, models: np.ndarray) -> np.ndarray:
        """Positives and negatives of some models' bags: (2, model)."""

        def count(blocks: Iterator[Standing]) -> Iterator[np.ndarray]:
            out = np.zeros((2, len(models)))
            for block in blocks:
                out += block.drawn[:, :, models].sum(axis=1)
            yield out

        return summed(self.held.mapPartitions(count))

    def move(self, splits: np.ndarray, ordered: np.ndarray, fill: np.ndarray) -> None:
        moves = Moves(splits.astype(np.int32), ordered, fill)
        # Made, and cached, by the next count; until then it needs the last.
        self.before = self.held
        self.held = self.held.map(moves).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        for rdd in (self.held, self.before):
            if rdd is not None:
                rdd.unpersist()


class Here:
    """Where all groups stand, within a task: the bagged groups of every model, in order of their nodes."""

    def __init__(self, groups: Gathered, fill: np.ndarray, usable: np.ndarray, label: np.ndarray, tree_of: np.ndarray, seed: int):
        self.groups = len(groups.codes)
        #: Only features that vary, by ``column``.
        self.column = np.zeros(groups.codes.shape[1], dtype=np.int64)
        self.column[usable] = np.arange(len(usable))
        codes = groups.codes[:, usable]
        self.codes = np.where(codes == 0, fill[usable].astype(np.uint16), codes)
        self.whole = np.zeros((2, len(label)))
        learned = {int(j): groups.learned(int(j), NO_FOLD) for j in np.unique(label)}
        found = []
        for t in np.unique(tree_of).tolist():
            for m in np.flatnonzero(tree_of == t).tolist():
                rows = learned[int(label[m])]
                drawn = rows.tallied(bag(rows.key, seed, t))
                if rows.counts.any():
                    # A larger group's bag is one number for each class, so it may differ from label to label.
                    drawn = drawn + np.random.Generator(np.random.PCG64(int(salt(seed, t, 6)))).poisson(rows.counts)
                self.whole[:, m] = drawn.sum(axis=1)
                group = np.flatnonzero(drawn.any(axis=0)).astype(np.int32)
                found.append((group, np.full(len(group), m, dtype=np.int32), drawn[:, group].astype(np.float32)))
        self.group, self.model = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int32)]) for i in (0, 1))
        self.drawn = np.concatenate([f[2] for f in found] or [np.zeros((2, 0), np.float32)], axis=1)
        self.node = np.zeros(len(self.group), dtype=np.int32)
        self.slot, self.edges = self.node, np.zeros(1, dtype=np.int64)

    def _which(self, at: np.ndarray) -> np.ndarray:
        """Place in ``at`` (model, node) of every bagged group's node; -1 if not there."""
        width = int(max(at[:, 1].max(initial=0), self.node.max(initial=0))) + 1
        place = np.full((self.whole.shape[1], width), -1, dtype=np.int32)
        place[at[:, 0], at[:, 1]] = np.arange(len(at))
        return place[self.model, self.node]

    def keep(self, active: np.ndarray) -> None:
        """Only the groups of active nodes, (model, node) in order."""
        which = self._which(active)
        order = np.argsort(which, kind="stable")
        order = order[np.searchsorted(which[order], 0) :]
        self.group, self.model, self.node, self.drawn, self.slot = self.group[order], self.model[order], self.node[order], self.drawn[:, order], which[order]
        self.edges = np.searchsorted(self.slot, np.arange(len(active) + 1))

    def count(self, lo: int, rows: np.ndarray, features: np.ndarray, sizes: np.ndarray) -> Counted | None:
        """Of features that are the same in all of a node's groups, nothing is counted: they split nothing."""
        if not self.groups:
            return None
        n = len(rows)
        edges = self.edges[lo : lo + n + 1]
        own = slice(edges[0], edges[-1])
        size = np.diff(edges)
        there = np.flatnonzero(size)
        column = self.column[features]
        whole = self.codes.shape[1] <= ALL * features.shape[1]
        group = self.group[own]
        held = self.codes[group] if whole else self.codes[group[:, None], column[self.slot[own] - lo]]
        varies = np.zeros((n, held.shape[1]), dtype=bool)
        if len(there):
            first = edges[there] - edges[0]
            varies[there] = np.minimum.reduceat(held, first, axis=0) != np.maximum.reduceat(held, first, axis=0)
        # Nothing to part, whichever features are drawn.
        single = ~varies.any(axis=1) if whole else size < 2
        if whole:
            varies = varies[np.arange(n)[:, None], column]
        slot, which = np.nonzero(varies)
        feature, length = features[slot, which].astype(np.int64), size[slot]
        ends = np.cumsum(length)
        at = np.repeat(edges[slot] - edges[0] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)
        start = np.cumsum(sizes[feature]) - sizes[feature]
        cell = np.repeat(start, length) + self.codes[group[at], np.repeat(self.column[feature], length)]
        drawn = self.drawn[:, own][:, at]
        cells = int(sizes[feature].sum())
        if cells <= 4 * len(cell) + CELLS:
            sums = np.stack([np.bincount(cell, weights=d, minlength=cells) for d in drawn])
            met = np.flatnonzero(sums.any(axis=0))
            sums = sums[:, met].astype(np.int32)
        else:
            met, sums = merged((cell, drawn.astype(np.int32)), (np.zeros(0, dtype=np.int64), np.zeros((2, 0), dtype=np.int32)))
        return Counted((met, sums), start, feature, slot, single)

    def totals(self, models: np.ndarray) -> np.ndarray:
        return self.whole[:, models]

    def move(self, splits: np.ndarray, ordered: np.ndarray, fill: np.ndarray) -> None:
        which = self._which(splits[:, :2])
        rows = np.flatnonzero(which >= 0)
        _, _, feature, code, left = splits[which[rows]].T
        held = self.codes[self.group[rows], self.column[feature]]
        self.node[rows] = left + np.where(ordered[feature], held > code, held == code)

    def close(self) -> None:
        pass


def grow(place: ByJobs | Here, binning: Binning, fill: np.ndarray, usable: np.ndarray, numbers: np.ndarray, settings: Settings) -> Trees:
    """All trees of a batch of models; ``numbers`` are the models', for the draws."""
    models, sizes, ordered = len(numbers), binning.sizes, binning.ordered
    tree, groups = Trees.roots(models), place.groups
    used = np.ones(models, dtype=np.int64)
    k = max(1, int(math.sqrt(len(sizes))))
    # Nodes to look at: model, node, attempt, level.
    active = np.array([(m, 0, 0, 0) for m in range(models)], dtype=np.int64).reshape(-1, 4)
    weights = None
    try:
        while len(active) and len(usable):
            found, lo = [], 0
            active = active[np.lexsort((active[:, 1], active[:, 0]))]
            place.keep(active)
            most = np.minimum(tree.cover[active[:, 0], active[:, 1]], groups) if weights is not None else np.full(len(active), groups)
            for rows, features in _parts(active, most, usable, settings.seed, numbers, min(k, len(usable)), sizes):
                counts = place.count(lo, rows, features, sizes)
                lo += len(rows)
                if counts is None:
                    return tree
                if weights is None:
                    whole = place.totals(np.arange(models))
                    weights = np.stack([*bag_weights(*whole), *whole])
                    tree.value[:, 0] = _share(weights, np.arange(models), *whole)
                    tree.cover[:, 0] = whole.sum(axis=0)
                found.append((rows, *compare(counts, rows[:, 0], weights[:2], ordered, fill, settings.least), counts.single))
            active, splits = _apply(tree, used, found, weights, settings, usable, min(k, len(usable)))
            if len(splits):
                tree.depth += 1
                place.move(splits, ordered, fill)
    finally:
        place.close()
    tree.trim(int(used.max(initial=1)))
    return tree


def _share(weights: np.ndarray, model: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Weighted share of positives."""
    a, b = weights[0, model] * positive, weights[1, model] * negative
    return a / np.maximum(a + b, 1e-300)


def _parts(active: np.ndarray, most: np.ndarray, usable: np.ndarray, seed: int, numbers: np.ndarray, k: int, sizes: np.ndarray):
    """The nodes, in order, in stretches of bounded cells, with features drawn; ``most``: groups of rows that a node may have."""
    features = node_features(usable, seed, numbers[active[:, 0]], active[:, 1], active[:, 2], k)
    per = np.minimum(sizes[features], most[:, None]).sum(axis=1)
    piece = (np.cumsum(per) - per) // CELLS
    for i in np.unique(piece):
        own = np.flatnonzero(piece == i)
        yield active[own], features[own]


def _apply(tree: Trees, used: np.ndarray, found: list[tuple], weights: np.ndarray, settings: Settings, usable: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Write the splits into the trees; the next nodes, and the splits for ``Moves``."""
    rows, gain, feature, code, pl, nl, pr, nr, single = (np.concatenate(c) for c in zip(*found, strict=True))
    m, node, attempt, level = rows.T
    yes = np.flatnonzero(gain > 0)
    tree.widened(int((used + 2 * np.bincount(m[yes], minlength=len(used))).max()))
    # Children are numbered within each tree in the order of their parents.
    rank = np.arange(len(yes)) - np.searchsorted(m[yes], m[yes], side="left")
    child = used[m[yes]] + 2 * rank
    used += 2 * np.bincount(m[yes], minlength=len(used))
    at = m[yes], node[yes]
    tree.feature[at], tree.code[at], tree.left[at], tree.gain[at] = feature[yes], code[yes], child, gain[yes]
    splits = np.stack([m[yes], node[yes], feature[yes], code[yes], child], axis=1)
    more = []
    for side, (p, n) in enumerate(((pl, nl), (pr, nr))):
        p, n, c = p[yes], n[yes], child + side
        tree.value[m[yes], c], tree.cover[m[yes], c] = _share(weights, m[yes], p, n), p + n
        go = (p > 0) & (n > 0) & (p + n >= 2 * settings.least)
        if settings.depth is not None:
            go &= level[yes] + 1 < settings.depth
        more.append(np.stack([m[yes], c, np.zeros_like(c), level[yes] + 1], axis=1)[go])
    # Nodes that none of their features splits go on with the next features.
    again = (gain <= 0) & ~single & ((attempt + 1) * k < len(usable)) & (weights[2, m] > 0) & (weights[3, m] > 0)
    more.append(np.stack([m, node, attempt + 1, level], axis=1)[again])
    return np.concatenate(more), splits


@dataclass
class Forests:
    """Batches of trees, with the label of every model."""

    batches: list[tuple[Trees, np.ndarray]]
    binning: Binning
    fill: np.ndarray
    labels: int

    def score(self, table: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Kept columns of an encoded table and ``scores``: each label's mean share of positives."""
        width, n = len(self.binning.names), len(keep)
        sent = table.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([*[table.schema[c] for c in keep], T.StructField("scores", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: Forests = sent.value
            for batch in batches:
                codes, back = distinct_codes(batch.column(n), width)
                total, count = np.zeros((len(codes), own.labels)), np.zeros(own.labels)
                for tree, label in own.batches:
                    share = tree.values(codes, np.tile(own.fill, (len(label), 1)), own.binning.ordered)
                    for j in np.unique(label):
                        total[:, j] += share[:, label == j].sum(axis=1)
                        count[j] += (label == j).sum()
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(list((total / np.maximum(count, 1))[back]), pa.list_(pa.float64()))], names=[*keep, "scores"])

        return table.select(*keep, CODES).mapInArrow(run, schema)

    def score_once(self, table: DataFrame, keep: Sequence[str]) -> DataFrame:
        """As ``score``; distinct codes of the whole table go through the trees once."""
        each = spread(table.select(CODES).distinct()).withColumn("met", F.col(CODES))
        scored = stored(self.score(each, ["met"]), "scores")
        return table.select(*keep, F.col(CODES).alias("met")).join(scored, "met").select(*keep, "scores")

    def importances(self) -> list[tuple[str, float]]:
        """Share of each feature in a tree's decrease of impurity, mean over the trees that split.

        A category counts as ``feature_value``. Highest first, then by name.
        """
        sizes, n = self.binning.sizes, len(self.binning.numeric)
        starts = np.cumsum(sizes) - sizes
        total, count = np.zeros(int(sizes.sum())), 0
        for tree, _ in self.batches:
            model, node = np.nonzero(tree.feature >= 0)
            gain = tree.gain[model, node]
            whole = np.bincount(model, weights=gain, minlength=len(tree.feature))
            cell = starts[tree.feature[model, node]] + tree.code[model, node]
            total += np.bincount(cell, weights=gain / whole[model], minlength=len(total))
            count += int((whole > 0).sum())
        cells = np.split(total / max(count, 1), starts[1:])
        pairs = [(name, float(c.sum())) for name, c in zip(self.binning.numeric, cells, strict=False)]
        for name, values, c in zip(self.binning.categorical, self.binning.values, cells[n:], strict=True):
            pairs += [(f"{name}_{v}", float(x)) for v, x in zip(values, c[1:], strict=True)]
        return sorted(pairs, key=lambda p: (-p[1], p[0]))


def _models(labels: int, settings: Settings) -> np.ndarray:
    """(label, tree) of every model; trees are numbered alike for all labels."""
    return np.array([(j, t) for t in range(settings.trees) for j in range(labels)], dtype=np.int64).reshape(-1, 2)


def fit(blocks: RDD, binning: Binning, fill: np.ndarray, usable: np.ndarray, labels: int, settings: Settings) -> Forests:
    """``settings.trees`` trees for each label, a batch of models at a time.

    ``usable``: features that vary.
    """
    models, out = _models(labels, settings), []
    for at in range(0, len(models), BATCH):
        own = models[at : at + BATCH]
        place = ByJobs(blocks, own[:, 0], own[:, 1], settings.seed)
        out.append((grow(place, binning, fill, usable, np.arange(at, at + len(own)), settings), own[:, 0]))
    return Forests(out, binning, fill, labels)


def together(groups: int, features: int, models: int, tasks: int) -> int:
    """Models that a task grows at a time; the ``models`` are dealt to ``tasks`` or more."""
    return max(1, min(BATCH, -(-models // tasks), TOGETHER // (16 * max(1, groups * int(math.sqrt(features))))))


def fit_gathered(spark, groups: Gathered, binning: Binning, fill: np.ndarray, usable: np.ndarray, labels: int, settings: Settings) -> Forests:
    """As ``fit``, each batch of models within a task."""
    models, context = _models(labels, settings), spark.sparkContext
    size = together(*groups.codes.shape, len(models), 2 * context.defaultParallelism)
    sent = context.broadcast((groups, binning, fill, usable, models))

    def run(at: int) -> tuple[Trees, np.ndarray]:
        groups, binning, fill, usable, models = sent.value
        own = models[at : at + size]
        place = Here(groups, fill, usable, own[:, 0], own[:, 1], settings.seed)
        return grow(place, binning, fill, usable, np.arange(at, at + len(own)), settings), own[:, 0]

    starts = list(range(0, len(models), size))
    return Forests(context.parallelize(starts, max(1, len(starts))).map(run).collect() if starts else [], binning, fill, labels)


def encode_rows(
    df: DataFrame, keep: Sequence[str], numeric: Sequence[str], bits: str | None, nbits: int, learn: str | None = None,
    max_bins: int = 255, categorical: Sequence[str] = (), fills: Mapping[str, float | str | None] | None = None,
) -> tuple[Binning, DataFrame]:
    """Codes of numbers, of an array of bit positions and of categories.

    A missing value stands at its column's ``fills``, a number without one at 0.
    Cuts and categories come from the rows that meet ``learn``.
    """
    fills = fills or {}
    whole = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(fills.get(c) or 0.0))) for c in numeric}
    whole |= {c: F.coalesce(F.col(c).cast("string"), F.lit(fills.get(c))) for c in categorical}
    filled = df.withColumns(whole) if whole else df
    own = fit_binning(filled if learn is None else filled.where(learn), numeric, categorical, max_bins)
    table = encode(filled, own, [*keep, *([bits] if bits else [])])
    if not bits:
        return own, stored(table, "codes")
    binning = Binning((*own.numeric, *(f"FP{i}" for i in range(nbits))), own.categorical, own.cuts + (np.zeros(1),) * nbits, own.values)
    n, at = len(keep), 2 * len(own.numeric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.ones((batch.num_rows, nbits), dtype="<u2")
            column = batch.column(n)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            codes[row, pc.list_flatten(column).to_numpy(zero_copy_only=False)] = 2
            packed = [a[:at] + b.tobytes() + a[at:] for a, b in zip(batch.column(n + 1).to_pylist(), codes, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(packed, pa.binary())], names=[*keep, CODES])

    schema = T.StructType([*[table.schema[c] for c in keep], T.StructField(CODES, T.BinaryType())])
    return binning, stored(table.mapInArrow(run, schema), "codes")


def _usable(rows: DataFrame, binning: Binning) -> tuple[np.ndarray, np.ndarray]:
    """The code that stands for a missing one of each feature, and the features that vary."""
    counts = code_counts(rows, binning).get(0, [np.zeros(n) for n in binning.sizes])
    # Only a category has a missing code: a value not learned from, which equals none.
    return binning.ordered.astype(np.int64), np.flatnonzero([np.count_nonzero(c) > 1 for c in counts])


def fit_rows(rows: DataFrame, binning: Binning, id_col: str, labels: Sequence[str], settings: Settings) -> Forests:
    """Forests of all labels from the rows of an encoded table."""
    fill, usable = _usable(rows, binning)
    groups = gather(rows, binning, labels, id_col)
    if groups is not None:
        return fit_gathered(rows.sparkSession, groups, binning, fill, usable, len(labels), settings)
    blocks = to_blocks(rows, binning, labels, id_col)
    try:
        return fit(blocks, binning, fill, usable, len(labels), settings)
    finally:
        blocks.unpersist()


def scored_by_rows(rows: DataFrame, table: DataFrame, keep: Sequence[str], binning: Binning, id_col: str, labels: Sequence[str], settings: Settings) -> DataFrame:
    """Kept columns of ``table`` and ``scores`` by the forests of all labels from ``rows``.

    Where the distinct codes of both are few enough, a task grows some trees of a
    label and scores by them, so no tree leaves its task.
    """
    spark = rows.sparkSession
    each = stored(table.select(CODES).distinct(), "distinct")
    groups = gather(rows, binning, labels, id_col) if each.count() * 2 * len(binning.names) <= MOST else None
    if groups is None:
        return fit_rows(rows, binning, id_col, labels, settings).score_once(table, keep)
    fill, usable = _usable(rows, binning)
    met = each.toArrow().sort_by(CODES).column(CODES).combine_chunks()
    count, parallel = len(labels), spark.sparkContext.defaultParallelism
    # Parts of a label's trees: tasks are alike, and more than the cores.
    parts = max(1, min(settings.trees, -(-8 * parallel // max(1, count))))
    sent = spark.sparkContext.broadcast((groups, binning, fill, usable, unpack(met, len(binning.names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, binning, fill, usable, codes = sent.value
        for task in (n for batch in batches for n in batch.column(0).to_pylist()):
            j, part = task % count, task // count
            trees = np.arange(part, settings.trees, parts)
            total = np.zeros(len(codes))
            size = together(*groups.codes.shape, len(trees), -(-len(trees) // TREES))
            for lo in range(0, len(trees), size):
                own = trees[lo : lo + size]
                place = Here(groups, fill, usable, np.full(len(own), j), own, settings.seed)
                tree = grow(place, binning, fill, usable, own * count + j, settings)
                total += tree.values(codes, np.tile(fill, (len(own), 1)), binning.ordered).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(codes))), pa.array(np.full(len(codes), j)), pa.array(np.full(len(codes), part)), pa.array(total)], names=["at", "j", "part", "total"]
            )

    tasks = parts * count
    sums = spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(run, "at long, j long, part long, total double")
    # Parts are added up in order, so reruns agree.
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("part", "total"))), F.lit(0.0), lambda s, x: s + x["total"])
    per = sums.groupBy("at", "j").agg((whole / settings.trees).alias("score"))
    per = per.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "score"))), lambda x: x["score"]).alias("scores"))
    numbered = spark.createDataFrame(pa.table([pa.array(np.arange(len(met))), met], names=["at", "met"]), "at long, met binary")
    scored = stored(numbered.join(per, "at").select("met", "scores"), "scores")
    return table.join(scored, F.col(CODES) == F.col("met")).select(*keep, "scores")
