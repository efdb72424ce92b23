"""Histogram trees: boosting with second-order gains, and forests, of many settings and folds at once.

The training rows are stored once in blocks: inputs as bin numbers, the label, the fold, a hash of the key. A level of all trees that are
growing, of all models, is one aggregate over (node, input, bin): a block adds up gradient, hessian and rows of every bin that
occurs, and the sums of a node meet in one task, which returns the node's best split. Only nodes reach the
driver, one row each. Tasks get the nodes back and find every row's place by walking down.

A node of at most ``NEAR_ROWS`` rows is grown to its end at once: its rows meet in one task, which goes on by the same sums and splits. So the number of jobs
follows from how often the rows must be halved to get there, not from the depth of the trees. A forest's small nodes wait for each other and end in one job. Boosters do so
up to ``NEAR_MODEL`` training rows; beyond, a level's sums are less to send than its rows.

A search has many boosters, whose rounds follow one another: up to ``ALONE_ROWS`` training rows each is grown by one task, which gets the blocks and grows all rounds by the
same sums and splits, so that the search is one job (``Growth.grow_apart``). Beyond, rows are never brought together, and a level of all boosters is a job.
A large forest's trees are grown by tasks as well, and its nodes stay there (``forest``).

Sums are integers: gradients are rounded to a fixed point that fits the number of rows. So they do not depend on the order of
addition, and trees not on partitioning, failures or the size of blocks. Equal gains go to the earlier input, then the lower bin.

Which rows a tree sees depends on the row's key and the tree's number alone: a forest's bootstrap weight is a Poisson(1) number from a hash of both,
and boosting keeps a share of the rows by the same hash.

Gain and value of a node with gradient G and hessian H are those of the squared loss with penalty L: G^2 / (H + L) and
-G / (H + L). A forest's tree is the same with gradient (mean - y) and L = 0: its gain is the loss of variance, its value the mean.

Defined results. Rows with a missing input, label or fold do not train. Repeated rows count each, and share their weights. No training rows: trees of one
node with value 0. A split that gains nothing is not made.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY_COLS, LABEL_COL
from ..session import materialize

#: Bins of an input, as many as fit a byte.
BINS = 256
BLOCK_ROWS = 1 << 14
#: Quantiles are exact up to about so many rows, and within a rank error of 1 in so many beyond.
ACCURACY = 25_600
#: Held out by a model that trains on all rows, and the fold of rows that are in none.
NO_FOLD, UNFOLDED = -1, -2
# Penalty on leaf values, smallest hessian of a child, smallest gain of a boosted split.
PENALTY, LEAST_CHILD, LEAST_GAIN = 1.0, 1.0, 1e-6
#: Trees per model after which margins are written again.
MARGIN_TREES = 8
#: Sums that one task takes before another one is used.
TASK_SUMS = 1 << 20
#: Rows of a node that one task takes, training rows up to which boosters do so too, rows that a task grows side by side, and that it takes before another one is used.
NEAR_ROWS, NEAR_MODEL, NEAR_CHUNK, TASK_ROWS = 1 << 14, 1 << 17, 1 << 15, 1 << 20
#: Training rows up to which one task grows a booster of a search, or trees of a forest; a million take a booster about 100 MB.
ALONE_ROWS = 1 << 23
#: Rows of a booster that are counted at a time, up to which all inputs are counted at once, and up to which each by itself; pairs of bins that are counted together.
COUNT_ROWS, FEW_ROWS, JOINT_ROWS, JOINT_BINS = 1 << 16, 1 << 11, 1 << 15, 1 << 13
#: Rows times trees of a forest up to which the driver holds its nodes, and nodes that are written as one row.
HELD, STRETCH = 1 << 20, 1 << 18
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Spec:
    """One model: a boosted one of ``trees`` rounds, or a forest. Rows of ``fold`` are held out."""

    trees: int
    depth: int | None = None
    rate: float = 1.0
    share: float = 1.0
    least_rows: int = 2
    forest: bool = False
    fold: int = NO_FOLD
    seed: int = 42

    @property
    def penalty(self) -> float:
        return 0.0 if self.forest else PENALTY


# --- rows in blocks ---


def bin_edges(df: DataFrame, cols: list[str], bins: int = BINS) -> list[list[float]]:
    """Values that cut each input into at most ``bins`` bins: a value belongs to the first edge that is not below it."""
    grid = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), grid, ACCURACY).alias(c) for c in cols]).first()
    return [sorted(set(row[c] or [])) for c in cols]


def binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(np.asarray(e, float), values[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8)


BLOCK = "block long, n int, key binary, bins binary, y binary, fold binary"


def blocks(df: DataFrame, cols: list[str], edges: list[list[float]], fold: str | None = None, label: str = LABEL_COL) -> DataFrame:
    """The rows that can train, in blocks of at most BLOCK_ROWS, written."""
    held = F.lit(UNFOLDED) if fold is None else F.col(fold)
    rows = df.select(
        F.xxhash64(*KEY_COLS).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(label).cast("double").alias("y"), held.cast("int").alias("fold")
    ).dropna()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                column = lambda c: part.column(c).to_numpy(zero_copy_only=False)
                x = np.stack([column(f"x{i}") for i in range(len(cols))], axis=1)
                packed = [column("key").astype("<i8"), binned(x, edges), column("y").astype("<f8"), column("fold").astype("<i4")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(column("key")[0])]), pa.array([part.num_rows], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in packed]],
                    names=["block", "n", "key", "bins", "y", "fold"],
                )

    return materialize(rows.mapInArrow(pack, BLOCK), "tree-blocks")


@dataclass
class Block:
    key: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    margin: np.ndarray | None

    @classmethod
    def of(cls, row: dict, n_inputs: int, n_models: int) -> Block:
        n = row["n"]
        margin = np.frombuffer(row["margin"], "<f8").reshape(n_models, n) if row.get("margin") else None
        return cls(
            np.frombuffer(row["key"], "<u8"), np.frombuffer(row["bins"], np.uint8).reshape(n, n_inputs),
            np.frombuffer(row["y"], "<f8"), np.frombuffer(row["fold"], "<i4"), margin,
        )


def _mixed(x: np.ndarray) -> np.ndarray:
    """A good hash of 64-bit numbers: multiply and shift, thrice."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def chance(key: np.ndarray, number: int, seed: int) -> np.ndarray:
    """A uniform number in [0, 1) of each key for a tree's number."""
    of_tree = _mixed(np.array([seed * 1_000_003 + number + 1], np.uint64) * _GOLDEN)[0]
    return (_mixed(key.astype(np.uint64) ^ of_tree) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _poisson_steps() -> np.ndarray:
    terms = [np.exp(-1.0)]
    for k in range(1, 19):
        terms.append(terms[-1] / k)
    return np.cumsum(terms)


_STEPS = _poisson_steps()


def row_weights(key: np.ndarray, spec: Spec, number: int) -> np.ndarray:
    if spec.forest:
        return np.searchsorted(_STEPS, chance(key, number, spec.seed), "right").astype(np.int64)
    if spec.share >= 1.0:
        return np.ones(len(key), np.int64)
    return (chance(key, number, spec.seed) < spec.share).astype(np.int64)


def _deepest(spec: Spec) -> int:
    return np.iinfo(np.int16).max if spec.depth is None else spec.depth


# --- nodes ---


@dataclass
class Nodes:
    """All nodes of all trees. The children of a node are ``left`` and ``left + 1``; a leaf has -1 there."""

    tree: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    depth: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    g: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    h: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __len__(self) -> int:
        return len(self.tree)

    def add(self, tree: np.ndarray, depth: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Numbers of new leaves."""
        n = len(tree)
        new = {"tree": tree, "feature": np.full(n, -1), "bin": np.zeros(n), "left": np.full(n, -1), "depth": depth, "g": g, "h": h, "rows": rows, "gain": np.zeros(n)}
        first = len(self)
        for name, values in new.items():
            own = getattr(self, name)
            setattr(self, name, np.concatenate((own, np.asarray(values).astype(own.dtype))))
        return np.arange(first, first + n)


def walk(bins: np.ndarray, root: int, feature: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    node = np.full(len(bins), root, np.int64)
    if left[root] < 0:
        return node
    flat, going, here = bins.ravel(), np.arange(len(bins)), node
    start = going * bins.shape[1]
    while len(going):
        here = left[here] + (flat[start + feature[here]] > at[here])
        on = left[here] >= 0
        if not on.all():
            node[going[~on]] = here[~on]
            going, start, here = going[on], start[on], here[on]
    return node


def leaf_values(g: np.ndarray, h: np.ndarray, scale: float, penalty: np.ndarray | float, rate: np.ndarray | float) -> np.ndarray:
    """What leaves add to the prediction."""
    found = g / -scale
    found /= np.maximum(h + penalty, 1e-300)
    found *= rate
    found *= h > 0
    return found


@dataclass
class Level:
    """What the tasks of a level need: nodes from ``offset`` on, the trees that grow and those finished since margins were written."""

    specs: list[Spec]
    base: list[float]
    scale: float
    offset: int
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    frontier: np.ndarray
    #: (model, tree number, root)
    growing: list[tuple[int, int, int]]
    #: model -> roots
    finished: dict[int, list[int]]
    groups: int
    n_inputs: int

    def margin(self, block: Block, model: int) -> np.ndarray:
        if block.margin is None:
            margin = np.full(len(block.y), self.base[model])
        else:
            margin = block.margin[model // self.groups].copy()
        for root in self.finished.get(model, ()):
            margin += self.value[walk(block.bins, root - self.offset, self.feature, self.bin, self.left)]
        return margin


#: What a task sends of a block: sums by key, or rows (their places, gradients, weights and bins) of nodes that are grown to their end.
SUMS = "p int, near boolean, key binary, g binary, h binary, rows binary, bins binary"


def _merged(key: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of equal keys, in order of key."""
    if not len(key):
        return key, sums
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], [np.add.reduceat(s[order], first) for s in sums]


def histogram(slot: np.ndarray, n_slots: int, bins: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(key, [G, H, rows]) in order of key; key is (slot, input, bin). Large nodes count into all their bins, small ones are sorted."""
    n, n_inputs = bins.shape
    if n_slots * BINS > 2 * n:
        key = ((slot[:, None] * n_inputs + np.arange(n_inputs)) * BINS + bins).ravel()
        return _merged(key, [np.repeat(x, n_inputs) for x in (g, w, np.ones(n, np.int64))])
    # Counting adds up doubles, exactly below 2^53: gradients go in two parts, and the number of rows above the lower one.
    wide = n.bit_length()
    cut = min(24, 53 - 2 * wide)
    if cut < 9:
        half = n // 2
        own = (histogram(slot[a:b], n_slots, bins[a:b], g[a:b], w[a:b]) for a, b in ((0, half), (half, n)))
        return _merged(*(lambda keys, sums: (np.concatenate(keys), [np.concatenate(x) for x in zip(*sums)]))(*zip(*own)))
    once = bool((w == 1).all())
    parts = [(g >> cut).astype(float), ((g & ((1 << cut) - 1)) + (1 << (cut + wide))).astype(float), *([] if once else [w.astype(float)])]
    first, size = slot * BINS, n_slots * BINS
    dense = np.empty((len(parts), n_slots, n_inputs, BINS))
    for f in range(n_inputs):
        key = first + bins[:, f]
        for k, x in enumerate(parts):
            dense[k, :, f] = np.bincount(key, x, size).reshape(n_slots, BINS)
    dense = dense.reshape(len(parts), -1)
    key = np.flatnonzero(dense[1])
    high, low, *weight = dense[:, key].astype(np.int64)
    rows = low >> (cut + wide)
    return key, [(high << cut) + (low & ((1 << (cut + wide)) - 1)), rows if once else weight[0], rows]


def contributions(block: Block, group: int, level: Level, near: np.ndarray) -> Iterator[tuple[bool, np.ndarray, list[np.ndarray], np.ndarray | None]]:
    """(near, key, sums, bins) of a block, tree by tree: sums by (place in the frontier, input, bin), and the rows of ``near`` places as they are."""
    place = np.full(len(level.left), -1, np.int64)
    place[level.frontier - level.offset] = np.arange(len(level.frontier))
    margins = {}
    for model, number, root in level.growing:
        if model % level.groups != group:
            continue
        spec = level.specs[model]
        weight = row_weights(block.key, spec, number) * (block.fold != spec.fold)
        rows = np.flatnonzero(weight)
        slot = place[walk(block.bins[rows], root - level.offset, level.feature, level.bin, level.left)]
        rows, slot = rows[slot >= 0], slot[slot >= 0]
        if not len(rows):
            continue
        if model not in margins:
            margins[model] = np.rint((level.margin(block, model) - block.y) * level.scale).astype(np.int64)
        w, close = weight[rows], near[slot]
        own = margins[model][rows] * w
        if close.any():
            yield True, slot[close], [own[close], w[close], np.zeros(0, np.int64)], block.bins[rows[close]]
        if not close.all():
            far = ~close
            places, at = np.unique(slot[far], return_inverse=True)
            key, sums = histogram(at, len(places), block.bins[rows[far]], own[far], w[far])
            stretch = level.n_inputs * BINS
            yield False, places[key // stretch] * stretch + key % stretch, sums, None


@dataclass
class Limits:
    """Of the places of a frontier: penalty, smallest gain, levels still allowed below, smallest split, and whether one task ends them."""

    penalty: np.ndarray
    least: np.ndarray
    deeper: np.ndarray
    fewest: np.ndarray
    near: np.ndarray

    def of(self, places: np.ndarray) -> Limits:
        return Limits(*(getattr(self, f)[places] for f in ("penalty", "least", "deeper", "fewest", "near")))


GROWN = "slot int, node int, left int, depth short, feature short, bin short, gain double, g long, h long, n long"
GROWN_TYPES = {"slot": np.int32, "node": np.int32, "left": np.int32, "depth": np.int16, "feature": np.int16, "bin": np.int16, "gain": np.float64, "g": np.int64, "h": np.int64, "n": np.int64}


class Part:
    """Nodes below places of a frontier as a task finds them. ``node`` numbers them within their place, 0 is the place itself; children are ``left`` and ``left + 1``."""

    def __init__(self, n_places: int) -> None:
        self.found, self.count = [], np.ones(n_places, np.int64)

    def enter(self, place: np.ndarray, node: np.ndarray, depth: int, s: dict[str, np.ndarray], limits: Limits) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Add nodes with the split of each; returns (whether it is made, (place, node, g, h, rows) of the children, in pairs). Nodes come in order of place."""
        made = (s["feature"] >= 0) & (depth < limits.deeper[place]) & (s["n"] >= limits.fewest[place])
        parent = place[made]
        rank = np.arange(len(parent)) - np.searchsorted(parent, parent)
        child = self.count[parent] + 2 * rank
        self.count += 2 * np.bincount(parent, minlength=len(self.count))
        left = np.full(len(place), -1, np.int64)
        left[made] = child
        self._add(place, node, left, depth, np.where(made, s["feature"], -1), np.where(made, s["bin"], 0), np.where(made, s["gain"], 0.0), s["g"], s["h"], s["n"])
        both = lambda a, b: np.stack((a, b), axis=1).ravel()
        below = [both(s[c + "l"][made], s[c][made] - s[c + "l"][made]) for c in "ghn"]
        return made, (np.repeat(parent, 2), both(child, child + 1), *below)

    def leaves(self, place: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> None:
        none = np.full(len(place), -1, np.int64)
        self._add(place, node, none, depth, none, none + 1, np.zeros(len(place)), g, h, n)

    def _add(self, place, node, left, depth, *rest) -> None:
        self.found.append([x.astype(t) for x, t in zip((place, node, left, np.full(len(place), depth), *rest), GROWN_TYPES.values())])

    def table(self) -> dict[str, np.ndarray]:
        """The nodes of a single place in order of their number."""
        columns = [np.concatenate(x) for x in zip(*self.found)]
        order = np.argsort(columns[1])
        return {name: x[order] for name, x in zip(GROWN_TYPES, columns)}

    def batch(self, slots: np.ndarray) -> pa.RecordBatch:
        """The nodes, those of a place together and in order of their number."""
        columns = [np.concatenate(x) for x in zip(*self.found)]
        order = np.lexsort((columns[1], columns[0]))
        columns[0] = slots[columns[0]].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(columns[0][order]), *[pa.array(x[order]) for x in columns[1:]]], names=list(GROWN_TYPES))


def one_level(key: np.ndarray, sums: list[np.ndarray], n_inputs: int, scale: float, limits: Limits) -> pa.RecordBatch:
    """The nodes of the sums, each with its best split and children."""
    s = best_splits(key, sums, n_inputs, scale, limits.penalty, limits.least)
    slots = s["slot"]
    part, place = Part(len(slots)), np.arange(len(slots))
    _, (of, node, g, h, n) = part.enter(place, np.zeros(len(slots), np.int64), 0, s, limits.of(slots))
    part.leaves(of, node, g, h, n, 1)
    return part.batch(slots)


def to_the_end(slot: np.ndarray, bins: np.ndarray, g: np.ndarray, w: np.ndarray, scale: float, limits: Limits) -> Iterator[pa.RecordBatch]:
    """All nodes below the places of these rows, some places at a time."""
    order = np.argsort(slot, kind="stable")
    slots, first = np.unique(slot[order], return_index=True)
    ends, a = np.r_[first[1:], len(order)], 0
    while a < len(slots):
        b = max(a + 1, int(np.searchsorted(ends, first[a] + NEAR_CHUNK, "right")))
        rows = order[first[a] : ends[b - 1]]
        yield _grown(np.searchsorted(slots[a:b], slot[rows]), bins[rows], g[rows], w[rows], scale, limits.of(slots[a:b])).batch(slots[a:b])
        a = b


def _grown(at: np.ndarray, bins: np.ndarray, g: np.ndarray, w: np.ndarray, scale: float, limits: Limits) -> Part:
    n_places = len(limits.least)
    part, place, node, depth = Part(n_places), np.arange(n_places), np.zeros(n_places, np.int64), 0
    while len(place):
        key, sums = histogram(at, len(place), bins, g, w)
        s = best_splits(key, sums, bins.shape[1], scale, limits.penalty[place], limits.least[place])
        made, below = part.enter(place, node, depth, s, limits)
        depth += 1
        on = (depth < limits.deeper[below[0]]) & (below[4] >= np.maximum(limits.fewest[below[0]], 2))
        part.leaves(*[x[~on] for x in below], depth)
        # Rows go to their child, if it can be split in turn.
        rows = np.flatnonzero(made[at])
        here = at[rows]
        child = 2 * (np.cumsum(made) - 1)[here] + (bins[rows, s["feature"][here]] > s["bin"][here])
        rows, child = rows[on[child]], child[on[child]]
        at, bins, g, w = (np.cumsum(on) - 1)[child], bins[rows], g[rows], w[rows]
        place, node = below[0][on], below[1][on]
    return part


def whole_tree(bins: np.ndarray, g: np.ndarray, w: np.ndarray, scale: float, spec: Spec) -> WholeTree:
    """A forest's tree of these rows: level by level while nodes have more than NEAR_ROWS rows, then some small ones at a time to their end."""
    limits = lambda depth: Limits(*(np.full(len(depth), x) for x in (spec.penalty, 0.0)), _deepest(spec) - depth, np.full(len(depth), spec.least_rows), np.full(len(depth), True))
    none = np.zeros(1, np.int64)
    part, node, depth, rows, at = Part(1), none, 0, np.arange(len(g)), np.zeros(len(g), np.int64)
    small = []
    if not len(g):
        part.leaves(none, none, none, none, none, 0)
        node = none[:0]
    elif len(g) <= NEAR_ROWS:
        part.leaves(none, none, none, none, none, 0)
        small, node = [(rows, at, none)], none[:0]
    while len(node):
        key, sums = histogram(at, len(node), bins[rows], g[rows], w[rows])
        s = best_splits(key, sums, bins.shape[1], scale, np.full(len(node), spec.penalty), np.zeros(len(node)))
        made, below = part.enter(np.zeros(len(node), np.int64), node, depth, s, limits(np.zeros(1, np.int64)))
        depth += 1
        near = below[4] <= NEAR_ROWS
        on = (depth < _deepest(spec)) & (below[4] >= max(spec.least_rows, 2))
        part.leaves(*[x[near | ~on] for x in below], depth)
        own = np.flatnonzero(made[at])
        rows, here = rows[own], at[own]
        child = 2 * (np.cumsum(made) - 1)[here] + (bins[rows, s["feature"][here]] > s["bin"][here])
        own = (near & on)[child]
        if own.any():
            small.append((rows[own], below[1][child[own]], below[1][near & on]))
        own = (on & ~near)[child]
        rows, at, node = rows[own], (np.cumsum(on & ~near) - 1)[child[own]], below[1][on & ~near]
    c = part.table()
    if small:
        rows, slot, _ = (np.concatenate(x) for x in zip(*small))
        kept = ("slot", "node", "left", "depth", "feature", "bin", "g", "h", "n")
        grown = [[batch.column(k).to_numpy() for k in kept] for batch in to_the_end(slot, bins[rows], g[rows], w[rows], scale, limits(c["depth"].astype(np.int64)))]
        s = dict(zip(kept, (np.concatenate(x) for x in zip(*grown))))
        grown.clear()
        top, old = s["node"] == 0, len(c["node"])
        # A place's nodes come together: its first child has the number of all children before.
        left = np.where(s["left"] >= 0, np.repeat(old + np.cumsum(~top)[top], np.diff(np.r_[np.flatnonzero(top), len(top)])) + s["left"] - 1, -1)
        depth_of = c["depth"][s["slot"]] + s["depth"]
        here = s["slot"][top]
        for k, x in {**{k: s[k] for k in ("feature", "bin", "g", "h", "n")}, "left": left, "depth": depth_of}.items():
            c[k][here] = x[top]
            c[k] = np.concatenate((c[k], x[~top].astype(c[k].dtype)))
    order = breadth_first(c["left"])
    return WholeTree.of(*(c[k][order] for k in ("feature", "bin", "g", "h", "n")))


def breadth_first(left: np.ndarray) -> np.ndarray:
    """The nodes that a tree's root reaches, level by level; children in the order of their parents."""
    levels, here = [], np.zeros(1, np.int64)
    while len(here):
        levels.append(here)
        here = left[here]
        here = (here[here >= 0].astype(np.int64)[:, None] + np.arange(2)).ravel()
    return np.concatenate(levels)


@dataclass
class WholeTree:
    """A tree breadth first: the children of its k-th split are the nodes 2k - 1 and 2k. So splits and the sums of leaves are all that needs to be kept."""

    feature: np.ndarray
    bin: np.ndarray
    g: np.ndarray
    h: np.ndarray
    n: np.ndarray
    left: np.ndarray
    depth: np.ndarray

    @classmethod
    def of(cls, feature: np.ndarray, bin_: np.ndarray, *sums: np.ndarray) -> WholeTree:
        inner = feature >= 0
        depth, a, b, level = np.zeros(len(feature), np.int16), 0, 1, 0
        while a < b:
            depth[a:b] = level
            a, b, level = b, b + 2 * int(inner[a:b].sum()), level + 1
        return cls(feature, bin_, *sums, np.where(inner, 2 * np.cumsum(inner, dtype=np.int32) - 1, np.int32(-1)), depth)

    def packed(self) -> Iterator[list]:
        """Stretches of nodes as bytes: input and bin of each, gradient, hessian and rows of leaves."""
        for a in range(0, len(self.feature), STRETCH):
            own = slice(a, a + STRETCH)
            leaf = self.feature[own] < 0
            values = ((self.feature[own], "<i2"), (self.bin[own], "u1"), *((x[own][leaf], "<i8") for x in (self.g, self.h, self.n)))
            yield [x.astype(t).tobytes() for x, t in values]

    @classmethod
    def unpacked(cls, stretches: list[tuple]) -> WholeTree:
        feature, bin_, *of_leaves = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*stretches), ("<i2", "u1", "<i8", "<i8", "<i8")))
        inner = feature >= 0
        ends, a, b = [], 0, 1
        while a < b:
            ends.append((a, b))
            a, b = b, b + 2 * int(inner[a:b].sum())
        sums = []
        for x in of_leaves:
            whole = np.zeros(len(feature), np.int64)
            whole[~inner] = x
            for (a, b), (c, d) in zip(ends[-2::-1], ends[:0:-1]):
                whole[a + np.flatnonzero(inner[a:b])] = whole[c:d].reshape(-1, 2).sum(axis=1)
            sums.append(whole)
        return cls.of(feature, bin_, *sums)

    def stopped(self, depth: int | None, least_rows: int) -> np.ndarray:
        """``left`` of the tree stopped at ``depth`` and below ``least_rows`` rows."""
        return np.where((self.depth >= (np.iinfo(np.int16).max if depth is None else depth)) | (self.n < least_rows), np.int32(-1), self.left)

    def values(self, scale: float, spec: Spec) -> np.ndarray:
        return leaf_values(self.g, self.h, scale, spec.penalty, spec.rate)

    def gains(self, left: np.ndarray, scale: float) -> np.ndarray:
        """The gain of each split, as ``best_splits`` has it."""
        own = np.flatnonzero(left >= 0)
        part = lambda at: np.square(self.g[at] / scale) / np.maximum(self.h[at], 1e-300)
        out = np.zeros(len(left))
        out[own] = part(left[own]) + part(left[own] + 1) - part(own)
        return out


APART = f"model int, {GROWN}"


class Counts:
    """Sums of gradients and rows by input and bin, of any rows of a booster. Tables are (input, bin) laid flat.

    Inputs of few bins are counted together with one of many, by pairs of bins, whose sums along each are those of the inputs.
    Adding up is done in doubles, of so many rows at a time that no sum reaches 2^53; gradients beyond that go in two parts. So sums are those of integers.
    """

    def __init__(self, bins: np.ndarray) -> None:
        self.columns = np.ascontiguousarray(bins.T)
        self.n_inputs = len(self.columns)
        self.first = np.arange(0, self.n_inputs * BINS, BINS)[:, None]
        size = [int(c.max(initial=0)) + 1 for c in self.columns]
        self.alone, self.together = [([f], [size[f]], c) for f, c in enumerate(self.columns)], []
        left = sorted(range(self.n_inputs), key=lambda f: (size[f], f))
        while left:
            own = [left.pop()]
            while left and np.prod([size[f] for f in (*own, left[0])]) <= JOINT_BINS:
                own.append(left.pop(0))
            joint = np.zeros(bins.shape[0], np.uint16)
            for f in own:
                joint *= np.uint16(size[f])
                joint += self.columns[f]
            self.together.append((own, [size[f] for f in own], joint))

    def weigh(self, g: np.ndarray) -> None:
        """Take the gradients of a round."""
        most = max(int(g.max(initial=0)), -int(g.min(initial=0)))
        parts = ((g, 0),) if most < 1 << (53 - COUNT_ROWS.bit_length()) else ((g >> 24, 24), (g & ((1 << 24) - 1), 0))
        self.parts = [(x.astype(float), shift) for x, shift in parts]

    def of(self, rows: np.ndarray | None) -> np.ndarray:
        """(2, input x bin): sums of the gradients, and counts. None is all rows."""
        out = np.zeros((2, self.n_inputs * BINS), np.int64)
        n = self.columns.shape[1] if rows is None else len(rows)
        groups = [] if n <= FEW_ROWS else self.alone if n <= JOINT_ROWS else self.together
        tables = [np.zeros((2, int(np.prod(size))), np.int64) for _, size, _ in groups]
        for a in range(0, n, COUNT_ROWS):
            own = slice(a, a + COUNT_ROWS) if rows is None else rows[a : a + COUNT_ROWS]
            weights = [(x[own], shift) for x, shift in self.parts]
            if n <= FEW_ROWS:
                key = (self.columns[:, own] + self.first).ravel()
                for x, shift in weights:
                    out[0] += np.bincount(key, np.tile(x, self.n_inputs), out.shape[1]).astype(np.int64) << shift
                out[1] += np.bincount(key, minlength=out.shape[1])
                continue
            for table, (_, size, joint) in zip(tables, groups):
                key, cells = joint[own].astype(np.intp), table.shape[1]
                for x, shift in weights:
                    table[0] += np.bincount(key, x, cells).astype(np.int64) << shift
                table[1] += np.bincount(key, minlength=cells)
        for table, (inputs, size, _) in zip(tables, groups):
            table = table.reshape(2, *size)
            for k, f in enumerate(inputs):
                out[:, f * BINS : f * BINS + size[k]] = table.sum(axis=tuple(j + 1 for j in range(len(size)) if j != k))
        return out


def boosted(key: np.ndarray, bins: np.ndarray, y: np.ndarray, spec: Spec, base: float, scale: float) -> Iterator[pa.RecordBatch]:
    """The trees of a booster of these rows, round by round; ``slot`` is the tree's number.

    Rows are kept by node. Of two children the one of fewer rows is counted, and the other is what its parent has more.
    """
    margin, every = np.full(len(y), base), np.arange(len(y))
    counts = Counts(bins)
    limits = Limits(*(np.array([x]) for x in (spec.penalty, LEAST_GAIN, _deepest(spec), spec.least_rows, True)))
    for number in range(spec.trees):
        g = np.rint((margin - y) * scale).astype(np.int64)
        if spec.share >= 1.0:
            own, rest = every, every[:0]
        else:
            drawn = row_weights(key, spec, number) > 0
            own, rest = np.flatnonzero(drawn), np.flatnonzero(~drawn)
        part, none, leaves = Part(1), np.zeros(1, np.int64), []
        if len(own):
            counts.weigh(g)
            # Of each open node: its number, sums, the rows that the tree sees, and the others.
            level, depth = [(0, counts.of(None if own is every else own), own, rest)], 0
        else:
            # A sample may hold no row at all; its tree is one leaf.
            part.leaves(none, none, none, none, none, 0)
            level, leaves = [], [(0, every)]
        while level:
            node = np.array([x[0] for x in level])
            sums = np.stack([x[1] for x in level], axis=1).reshape(2, -1)
            at = np.flatnonzero(sums[1])
            sum_g, n = sums[:, at]
            s = best_splits(at, [sum_g, n, n], bins.shape[1], scale, np.full(len(level), spec.penalty), np.full(len(level), LEAST_GAIN))
            made, below = part.enter(np.zeros(len(level), np.int64), node, depth, s, limits)
            depth += 1
            on = (depth < _deepest(spec)) & (below[4] >= max(spec.least_rows, 2))
            part.leaves(*[x[~on] for x in below], depth)
            leaves += [(number_, r) for (number_, _, *both), m in zip(level, made) if not m for r in both]
            above, level = [x for x, m in zip(level, made) if m], []
            for k, ((_, table, own, rest), f, b) in enumerate(zip(above, s["feature"][made].tolist(), s["bin"][made].tolist())):
                sides = []
                for rows in (own, rest):
                    right = counts.columns[f][rows] > b
                    sides.append((rows.compress(~right), rows.compress(right)))
                goes, number_ = on[2 * k : 2 * k + 2], below[1][2 * k : 2 * k + 2].tolist()
                if goes.any():
                    few = int(len(sides[0][1]) < len(sides[0][0]))
                    tables = [None, None]
                    tables[few] = counts.of(sides[0][few])
                    tables[1 - few] = table - tables[few]
                for i in (0, 1):
                    if goes[i]:
                        level.append((number_[i], tables[i], sides[0][i], sides[1][i]))
                    else:
                        leaves += [(number_[i], sides[0][i]), (number_[i], sides[1][i])]
        tree = part.batch(np.array([number]))
        value = leaf_values(*(tree.column(c).to_numpy() for c in ("g", "h")), scale, spec.penalty, spec.rate)
        for number_, rows in leaves:
            margin[rows] += value[number_]
        yield tree


def best_splits(key: np.ndarray, sums: list[np.ndarray], n_inputs: int, scale: float, penalty: np.ndarray, least: np.ndarray) -> dict[str, np.ndarray]:
    """The best split of every node in the sums; feature is -1 where nothing gains. ``penalty`` and ``least`` gain by place in the frontier."""
    stretch = key // BINS
    first = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])
    size = np.diff(np.r_[first, len(key)])
    last = first + size - 1
    through = [np.cumsum(s) for s in sums]
    left = [t - np.repeat(t[first] - s[first], size) for t, s in zip(through, sums)]
    whole = [np.repeat(x[last], size) for x in left]
    slot = stretch // n_inputs
    gl, hl, _ = left
    g, h, _ = whole
    more = penalty[slot]
    part = lambda a, b: np.square(a / scale) / np.maximum(b + more, 1e-300)
    gain = part(gl, hl) + part(g - gl, h - hl) - part(g, h)
    gain[last] = -np.inf  # nothing on the right
    gain[(hl < LEAST_CHILD) | (h - hl < LEAST_CHILD) | (gain <= least[slot])] = -np.inf
    start = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    most = np.maximum.reduceat(gain, start)
    at = np.where(gain == np.repeat(most, np.diff(np.r_[start, len(key)])), np.arange(len(key)), len(key))
    at = np.minimum.reduceat(at, start)
    found = most > -np.inf
    return {
        "slot": slot[at], "feature": np.where(found, stretch[at] % n_inputs, -1), "bin": key[at] % BINS, "gain": np.where(found, most, 0.0),
        "gl": gl[at], "hl": hl[at], "nl": left[2][at], "g": g[at], "h": h[at], "n": whole[2][at],
    }


class Growth:
    """Grows the trees of all specs together. ``groups`` deals models to tasks where blocks are fewer than cores."""

    def __init__(self, stored: DataFrame, specs: list[Spec], n_inputs: int) -> None:
        self.spark, self.stored, self.specs, self.n_inputs = stored.sparkSession, stored, specs, n_inputs
        self.cores = self.spark.sparkContext.defaultParallelism
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.nodes, self.roots = Nodes(), [[] for _ in specs]
        by_fold = _label_sums(stored)
        n, most = sum(x[0] for x in by_fold.values()), max([1.0, *(x[2] for x in by_fold.values())])
        self.base = [_mean(by_fold, s.fold) for s in specs]
        self.rows_of = np.array([sum(x[0] for f, x in by_fold.items() if f != s.fold or s.fold == NO_FOLD) for s in specs], np.int64)
        # Sums of n gradients, weights up to 32, stay below 2^62.
        self.scale = 2.0 ** min(30, 56 - int(np.ceil(np.log2(n + 2))) - int(np.ceil(np.log2(4 * most))))
        n_blocks = stored.count()
        self.groups = max(1, min(len(specs), -(-self.cores // max(1, n_blocks))))
        self.tasks = max(1, min(max(self.parts, self.cores), n_blocks * self.groups))
        units = stored.select("n", "key", "bins", "y", "fold", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("group"), F.lit(None).cast("binary").alias("margin"))
        self.units = units.repartition(self.tasks).persist()
        self.offset, self.since = 0, {m: [] for m in range(len(specs))}
        self.levels = 0

    def values(self, cut: slice | np.ndarray = slice(None)) -> np.ndarray:
        """What a leaf adds to the prediction."""
        model, h = self.model_of[self.nodes.tree[cut]], self.nodes.h[cut]
        penalty, rate = (np.array([getattr(s, k) for s in self.specs])[model] for k in ("penalty", "rate"))
        return leaf_values(self.nodes.g[cut], h, self.scale, penalty, rate)

    @property
    def model_of(self) -> np.ndarray:
        """The model of every tree."""
        return np.array(self._tree_model, np.int32)

    def grow(self) -> Growth:
        """All trees of all specs; a forest's grow side by side, a booster's one after the other."""
        self._tree_model, self._tree_number = [], []
        growing: dict[int, int] = {}  # tree -> root
        frontier = self._plant([m for m, s in enumerate(self.specs) for _ in range(s.trees if s.forest else min(1, s.trees))], growing)
        while len(frontier):
            now, later = self._next(frontier)
            frontier = np.concatenate((self._split(self._level(growing, now)), later))
            still = set(self.nodes.tree[frontier].tolist())
            again = []
            for tree in [t for t in growing if t not in still]:
                model, root = self._tree_model[tree], growing.pop(tree)
                if not self.specs[model].forest:
                    self.since[model].append(root)
                    if len(self.roots[model]) < self.specs[model].trees:
                        again.append(model)
            planted = self._plant(again, growing)
            if growing and max(map(len, self.since.values())) >= MARGIN_TREES:
                self._write_margins(growing)
            frontier = np.concatenate((frontier, planted))
        self.units.unpersist()
        return self

    def fits_apart(self) -> bool:
        """Whether all models are boosters with rows, few enough for a task."""
        return not any(s.forest for s in self.specs) and bool((self.rows_of > 0).all() and (self.rows_of <= ALONE_ROWS).all())

    def is_large_forest(self) -> bool:
        """Whether this is one forest whose nodes the driver should not hold, of rows few enough for a task (see ``forest``)."""
        return len(self.specs) == 1 and self.specs[0].forest and bool(0 < self.rows_of[0] <= ALONE_ROWS) and self.specs[0].trees * int(self.rows_of[0]) > HELD

    def grow_apart(self) -> Growth:
        """The trees that ``grow`` grows, in one job: a task gets the blocks once and grows some boosters, each by itself, as much work as the others have."""
        self.levels += 1
        specs, base, scale, n_inputs = self.specs, self.base, self.scale, self.n_inputs
        n_tasks = min(len(specs), 2 * self.cores)
        work, load = [[] for _ in range(n_tasks)], [0] * n_tasks
        cost = [int(self.rows_of[m]) * s.trees * max(1, _deepest(s) - 1) for m, s in enumerate(specs)]
        for m in sorted(range(len(specs)), key=lambda m: (-cost[m], m)):
            least = load.index(min(load))
            work[least].append(m)
            load[least] += cost[m]

        def boost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, own = [], []
            for batch in batches:
                for row in batch.to_pylist():
                    found.append(Block.of({**row, "margin": None}, n_inputs, 0))
                    own = work[row["task"]]
            for m in own:
                trains = [b.fold != specs[m].fold for b in found]
                key, bins, y = (np.concatenate([getattr(b, name)[t] for b, t in zip(found, trains)]) for name in ("key", "bins", "y"))
                for tree in boosted(key, bins, y, specs[m], base[m], scale):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(tree.num_rows, m, np.int32)), *tree.columns], names=["model", *GROWN_TYPES])

        each = self.stored.select("n", "key", "bins", "y", "fold", F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1))).alias("task"))
        table = each.repartitionById(n_tasks, "task").mapInArrow(boost, APART).toArrow()
        c = {name: table.column(name).to_numpy() for name in table.column_names}
        order = np.lexsort((c["node"], c["slot"], c["model"]))
        c = {name: x[order] for name, x in c.items()}
        roots = np.flatnonzero(c["node"] == 0)
        tree = np.cumsum(c["node"] == 0) - 1
        self.nodes.add(tree, c["depth"], c["g"], c["h"], c["n"])
        self.nodes.left[:] = np.where(c["left"] >= 0, c["left"] + roots[tree], -1)
        self.nodes.feature[:], self.nodes.bin[:], self.nodes.gain[:] = c["feature"], c["bin"], c["gain"]
        self._tree_model, self._tree_number = c["model"][roots].tolist(), c["slot"][roots].tolist()
        for m, root in zip(self._tree_model, roots.tolist()):
            self.roots[m].append(root)
        self.units.unpersist()
        return self

    def _plant(self, models: list[int], growing: dict[int, int]) -> np.ndarray:
        """A new tree for each of the models; their roots."""
        first = len(self._tree_model)
        none = np.zeros(len(models), np.int64)
        # A root's rows are not counted yet: at most all of its model.
        roots = self.nodes.add(np.arange(first, first + len(models)), none, none, none, self.rows_of[models] if models else none)
        for tree, (model, root) in enumerate(zip(models, roots.tolist()), first):
            self._tree_model.append(model)
            self._tree_number.append(len(self.roots[model]))
            self.roots[model].append(root)
            growing[tree] = root
        return roots

    def _state(self, growing: dict[int, int], frontier: np.ndarray) -> Level:
        cut = slice(self.offset, None)
        left = np.where(self.nodes.left[cut] >= 0, self.nodes.left[cut] - self.offset, -1)
        return Level(
            self.specs, self.base, self.scale, self.offset, self.nodes.feature[cut], self.nodes.bin[cut], left, self.values(cut), frontier,
            [(self._tree_model[t], self._tree_number[t], r) for t, r in growing.items()], {m: r for m, r in self.since.items() if r}, self.groups, self.n_inputs,
        )

    def _models_in(self, group: int) -> int:
        return len(range(group, len(self.specs), self.groups))

    def _near(self, nodes: np.ndarray) -> np.ndarray:
        model = self.model_of[self.nodes.tree[nodes]]
        able = np.array([s.forest for s in self.specs]) | (self.rows_of <= NEAR_MODEL)
        return able[model] & (self.nodes.rows[nodes] <= NEAR_ROWS)

    def _next(self, frontier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes of the next job, nodes that wait): a forest's small nodes wait until there are no others."""
        forest = np.array([s.forest for s in self.specs])[self.model_of[self.nodes.tree[frontier]]]
        near = self._near(frontier)
        wait = forest & near & bool((forest & ~near).any())
        return frontier[~wait], frontier[wait]

    def _level(self, growing: dict[int, int], frontier: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(frontier, the nodes found below it): one shuffle."""
        self.levels += 1
        of_node, near = self.model_of[self.nodes.tree[frontier]], self._near(frontier)
        penalty, fewest, deepest = (np.array([f(s) for s in self.specs])[of_node] for f in (lambda s: s.penalty, lambda s: s.least_rows, _deepest))
        least = np.array([0.0 if s.forest else LEAST_GAIN for s in self.specs])[of_node]
        limits = Limits(penalty, least, deepest - self.nodes.depth[frontier], fewest, near)
        here = set(self.nodes.tree[frontier].tolist())
        shared = self.spark.sparkContext.broadcast((self._state({t: r for t, r in growing.items() if t in here}, frontier), limits))
        # Tasks as the sums and rows may need: a node has at most BINS of every input.
        n_near, n_far = int(near.sum()), int((~near).sum())
        far_parts = min(self.parts, n_far * self.n_inputs * BINS // TASK_SUMS)
        near_parts = min(n_near, max(self.cores, int(self.nodes.rows[frontier[near]].sum()) // TASK_ROWS))
        n_parts = max(1, far_parts, near_parts)
        n_inputs, scale, models_in = self.n_inputs, self.scale, [self._models_in(k) for k in range(self.groups)]
        types = ("<i8", "<i8", "<i8", "<i8", "u1")

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block.of(row, n_inputs, models_in[row["group"]])
                    for close, key, sums, bins in contributions(block, row["group"], shared.value[0], shared.value[1].near):
                        to = (key if close else key // (BINS * n_inputs)) % n_parts
                        ps, out = np.unique(to), []
                        for p in ps:
                            own = to == p
                            out.append([x[own] if len(x) else x for x in (key, *sums, np.zeros(0, np.uint8) if bins is None else bins)])
                        columns = [pa.array([x.astype(t).tobytes() for x in c], pa.binary()) for c, t in zip(zip(*out), types)]
                        yield pa.RecordBatch.from_arrays([pa.array(ps.astype(np.int32)), pa.array([close] * len(ps)), *columns], names=["p", "near", "key", "g", "h", "rows", "bins"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            limits = shared.value[1]
            key, sums, waiting, size, rows = np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 3, [], 0, []
            read = lambda x: np.frombuffer(x, "<i8")

            def merge():
                columns = [np.concatenate(x) for x in zip((key, *sums), *waiting)]
                return _merged(columns[0], columns[1:])

            for batch in batches:
                for row in batch.to_pylist():
                    if row["near"]:
                        rows.append((read(row["key"]), np.frombuffer(row["bins"], np.uint8).reshape(-1, n_inputs), read(row["g"]), read(row["h"])))
                        continue
                    waiting.append([read(row[c]) for c in ("key", "g", "h", "rows")])
                    size += len(waiting[-1][0])
                    if size > max(1 << 20, 2 * len(key)):
                        key, sums = merge()
                        waiting, size = [], 0
            key, sums = merge() if waiting else (key, sums)
            if len(key):
                yield one_level(key, sums, n_inputs, scale, limits)
            if rows:
                slot, bins, g, w = (np.concatenate(x) for x in zip(*rows))
                rows.clear()
                yield from to_the_end(slot, bins, g, w, scale, limits)

        sums = self.units.mapInArrow(add_up, SUMS)
        table = sums.repartitionById(n_parts, "p").mapInArrow(choose, GROWN).toArrow()
        shared.destroy()
        return frontier, {c: table.column(c).to_numpy() for c in table.column_names}

    def _split(self, level: tuple[np.ndarray, dict[str, np.ndarray]]) -> np.ndarray:
        """Enter the nodes; returns those that can be split in turn."""
        frontier, s = level
        nodes, near, old = self.nodes, self._near(frontier), len(self.nodes)
        nodes.rows[frontier] = 0
        top = s["node"] == 0
        here, above = frontier[s["slot"][top]], frontier[s["slot"][~top]]
        # A place's nodes come together: its first child has the number of all children before.
        before = old + np.cumsum(~top)[top]
        left = np.where(s["left"] >= 0, np.repeat(before, np.diff(np.r_[np.flatnonzero(top), len(top)])) + s["left"] - 1, -1)
        nodes.g[here], nodes.h[here], nodes.rows[here] = s["g"][top], s["h"][top], s["n"][top]
        below = nodes.add(nodes.tree[above], nodes.depth[above] + s["depth"][~top], s["g"][~top], s["h"][~top], s["n"][~top])
        for to, of in ((here, top), (below, ~top)):
            nodes.left[to], nodes.feature[to], nodes.bin[to], nodes.gain[to] = left[of], s["feature"][of], s["bin"][of], s["gain"][of]
        open_ = below[~near[s["slot"][~top]]]
        model = self.model_of[nodes.tree[open_]]
        deepest, fewest = (np.array([f(x) for x in self.specs])[model] for f in (_deepest, lambda x: x.least_rows))
        return open_[(nodes.depth[open_] < deepest) & (nodes.rows[open_] >= np.maximum(fewest, 2))]

    def _write_margins(self, growing: dict[int, int]) -> None:
        """Margins with all finished trees, written, so that no level walks down more than a few trees of a model."""
        shared = self.spark.sparkContext.broadcast(self._state({}, np.zeros(0, np.int64)))
        n_inputs, groups, n_models = self.n_inputs, self.groups, len(self.specs)
        models_in = [self._models_in(k) for k in range(groups)]

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block.of(row, n_inputs, models_in[row["group"]])
                    margins = np.stack([shared.value.margin(block, m) for m in range(row["group"], n_models, groups)])
                    yield pa.RecordBatch.from_pylist([{**row, "margin": margins.astype("<f8").tobytes()}], schema=batch.schema)

        old, self.units = self.units, materialize(self.units.mapInArrow(update, self.units.schema), "tree-margins").repartition(self.tasks).persist()
        old.unpersist()
        self.since = {m: [] for m in self.since}
        self.offset = min(growing.values(), default=len(self.nodes))

    # --- what a grown model says ---

    def squared_errors(self, stored: DataFrame, variants: list[tuple[int, int, int | None, int]]) -> list[tuple[float, float, float, int]]:
        """Per variant (model, first trees, depth, smallest split) the (squared error, sum of y, of y^2, rows) on the model's held-out fold.

        A variant of a forest stops its trees earlier, and so stands for one grown with these limits.
        """
        n = self.nodes
        shared = self.spark.sparkContext.broadcast((self.specs, self.roots, self.base, n.feature, n.bin, n.left, n.depth, n.rows, self.values()))
        n_inputs, todo = self.n_inputs, sorted({(m, d, k) for m, _, d, k in variants}, key=str)
        counts = {v: sorted({t for m, t, d, k in variants if (m, d, k) == v}) for v in todo}

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            specs, roots, base, feature, at, left, depth, rows, value = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block.of({**row, "margin": None}, n_inputs, 0)
                    m, d, k = todo[row["variant"]]
                    held = np.flatnonzero(block.fold == specs[m].fold)
                    ends = np.where((depth >= (np.iinfo(np.int16).max if d is None else d)) | (rows < k), -1, left)
                    total, y, bins, out = np.zeros(len(held)), block.y[held], block.bins[held], []
                    for t, root in enumerate(roots[m], 1):
                        total += value[walk(bins, root, feature, at, ends)]
                        if t in counts[m, d, k]:
                            p = base[m] + (total / t if specs[m].forest else total)
                            out.append({"variant": row["variant"], "trees": t, "sse": float(np.square(p - y).sum()), "sy": float(y.sum()), "syy": float(np.square(y).sum()), "n": len(y)})
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("variant", pa.int32()), ("trees", pa.int32()), ("sse", pa.float64()), ("sy", pa.float64()), ("syy", pa.float64()), ("n", pa.int64())]))

        each = stored.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(len(todo) - 1)))).repartition(self.parts)
        found = each.mapInArrow(measure, "variant int, trees int, sse double, sy double, syy double, n long")
        sums = found.groupBy("variant", "trees").agg(*[F.sum(c).alias(c) for c in ("sse", "sy", "syy", "n")]).collect()
        shared.destroy()
        by = {(*todo[r.variant], r.trees): (r.sse, r.sy, r.syy, r.n) for r in sums}
        return [by.get((m, d, k, t), (0.0, 0.0, 0.0, 0)) for m, t, d, k in variants]

    def model(self, index: int, cols: list[str], edges: list[list[float]], trees: int | None = None, depth: int | None = None, least_rows: int = 2) -> TreeModel:
        """One model of its first ``trees``, its trees stopped at ``depth`` and below ``least_rows`` rows."""
        n, spec = self.nodes, self.specs[index]
        stop = (n.depth >= (np.iinfo(np.int16).max if depth is None else depth)) | (n.rows < least_rows)
        left, kept = np.where(stop, np.int32(-1), n.left), np.array(self.roots[index][:trees], np.int64)
        # Level by level through all trees: a node's number is that of its place in its tree, breadth first.
        tree, here, count, levels = np.arange(len(kept)), kept, np.zeros(len(kept), np.int64), []
        while len(here):
            levels.append((tree, here, count[tree] + np.arange(len(tree)) - np.searchsorted(tree, tree)))
            count += np.bincount(tree, minlength=len(count))
            inner = left[here] >= 0
            tree, here = np.repeat(tree[inner], 2), (left[here[inner]][:, None] + np.arange(2)).ravel()
        first, number = np.cumsum(count) - count, np.empty(len(n), np.int32)
        order = np.empty(int(count.sum()), np.int32)
        for tree, here, numbers in levels:
            number[here] = numbers
            order[first[tree] + numbers] = here
        levels.clear()
        limit = np.zeros((len(edges), BINS))
        for i, e in enumerate(edges):
            limit[i, : len(e)] = e
        inner = left[order] >= 0
        inside = order[inner]

        def where_inner(values: np.ndarray, other: float, kind: type) -> np.ndarray:
            out = np.full(len(order), other, kind)
            out[inner] = values
            return out

        # One column after the other: a forest's table is large, and needs to be held once only.
        table = {
            "tree": np.repeat(np.arange(len(kept), dtype=np.int32), count), "node": number[order], "feature": where_inner(n.feature[inside], -1, np.int32),
            "threshold": where_inner(limit[n.feature[inside], n.bin[inside]], 0.0, np.float64), "left": where_inner(number[left[inside]], -1, np.int32),
            "gain": where_inner(n.gain[inside], 0.0, np.float64), "rows": n.rows[order], "weight": n.h[order], "value": self.values(order) / (len(kept) if spec.forest else 1),
        }
        return TreeModel(cols, self.base[index], pd.DataFrame(table, copy=False))


def _label_sums(stored: DataFrame) -> dict[int, tuple[int, int, float]]:
    """fold -> (rows, sum of labels in 2^-20, largest distance from 0); integers, so that any order gives the same."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                y, fold = np.frombuffer(row["y"], "<f8"), np.frombuffer(row["fold"], "<i4")
                for f in np.unique(fold):
                    own = y[fold == f]
                    yield pa.RecordBatch.from_pylist([{"fold": int(f), "n": len(own), "total": int(np.rint(own * 2**20).sum()), "most": float(np.abs(own).max())}], schema=pa.schema([("fold", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("most", pa.float64())]))

    sums = stored.select("y", "fold").mapInArrow(run, "fold int, n long, total long, most double").groupBy("fold")
    return {r.fold: (r.n, r.total, r.most) for r in sums.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most")).collect()}


def _mean(by_fold: dict[int, tuple[int, int, float]], held: int) -> float:
    n, total = (sum(x[i] for f, x in by_fold.items() if f != held or held == NO_FOLD) for i in (0, 1))
    return total / 2**20 / n if n else 0.0


# --- fitted models ---

NODE_COLUMNS = ["tree", "node", "feature", "threshold", "left", "gain", "rows", "weight", "value"]
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, gain double, rows long, weight long, value double"


class TreeModel:
    """A base value and a table of nodes; the prediction is the base plus the values of a row's leaves."""

    def __init__(self, cols: list[str], base: float, nodes: pd.DataFrame) -> None:
        self.cols, self.base = list(cols), base
        kinds = {**dict.fromkeys(NODE_COLUMNS, "int32"), **dict.fromkeys(("threshold", "gain", "value"), "float64"), "rows": "int64", "weight": "int64"}
        if (wrong := {c: k for c, k in kinds.items() if nodes[c].dtype != k}) or list(nodes) != NODE_COLUMNS:
            nodes = nodes[NODE_COLUMNS].astype(wrong)
        tree, node = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        if ((tree[1:] < tree[:-1]) | ((tree[1:] == tree[:-1]) & (node[1:] < node[:-1]))).any():
            nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        self.nodes = nodes

    def arrays(self) -> tuple[np.ndarray, ...]:
        """(roots, feature, threshold, left, value, weight) with nodes numbered through."""
        n = self.nodes
        roots = np.flatnonzero(n["node"].to_numpy() == 0)
        start = np.repeat(roots, np.diff(np.r_[roots, len(n)]))
        left = n["left"].to_numpy()
        return roots, n["feature"].to_numpy(), n["threshold"].to_numpy(), np.where(left >= 0, left + start, -1), n["value"].to_numpy(), n["weight"].to_numpy()

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``; NULL where an input is missing."""
        shared, base = df.sparkSession.sparkContext.broadcast(self.arrays()), self.base

        @F.pandas_udf("double")
        def predict(*inputs: pd.Series) -> pd.Series:
            roots, feature, threshold, left, value, _ = shared.value
            x = np.stack([i.to_numpy(float) for i in inputs], axis=1)
            total = np.full(len(x), base)
            for root in roots:
                total += value[descend(x, root, feature, threshold, left)]
            return pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, total))

        predicted = predict(*[F.col(c).cast("double") for c in self.cols])
        return df.withColumn("prediction", F.nanvl(predicted, F.lit(None).cast("double")))

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes.astype({"tree": "int32", "node": "int32", "feature": "int32", "left": "int32"}), NODE_SCHEMA)

    def importance(self) -> dict[str, float]:
        """Share of each input in the gains."""
        inner = self.nodes[self.nodes["feature"] >= 0].groupby("feature")["gain"].sum()
        total = inner.sum() or 1.0
        return {c: float(inner.get(i, 0.0) / total) for i, c in enumerate(self.cols)}

    def save(self, spark: SparkSession, path: str) -> None:
        self.node_table(spark).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps({"cols": self.cols, "base": self.base}),)], "value string").coalesce(1).write.text(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        told = json.loads(spark.read.text(f"{path}/model").first()[0])
        return cls(told["cols"], told["base"], spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").toPandas())


def descend(x: np.ndarray, root: int, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of every row of raw inputs; a missing input goes left."""
    node = np.full(len(x), root, np.int64)
    going = np.arange(len(x)) if left[root] >= 0 else np.zeros(0, np.int64)
    while len(going):
        here = node[going]
        node[going] = left[here] + (x[going, feature[here]] > threshold[here])
        going = going[left[node[going]] >= 0]
    return node


def fit_trees(train: DataFrame, cols: list[str], spec: Spec, label: str = LABEL_COL, bins: int = BINS) -> TreeModel:
    """One boosted model or forest."""
    edges = bin_edges(train.select(*cols, label).dropna(), cols, bins)
    growth = Growth(blocks(train, cols, edges, label=label), [spec], len(cols))
    if growth.is_large_forest():
        from .forest import write_forest

        return write_forest(growth, cols, edges)
    return growth.grow().model(0, cols, edges, least_rows=spec.least_rows)
