"""Filter interaction audit: what every order of a set of filters removes, from decision diagrams.

A document's failures are a mask with a bit per filter. Spark counts documents (all, good, toxic) by part and
mask: at most 2^k rows per part, whatever the input. From these rows one small
decision diagram is built per part. A level decides one filter; a node's weight is what passes
through it; equal subdiagrams of a level are one node. Leaves are the counts of a mask.

Orders are visited so that each follows from the one before by exchanging two adjacent filters. In the diagram that is a swap
of two adjacent levels, which touches these two levels only. On the path on which all filters pass, the fail
child of a level weighs what that step removes, and the pass child what it keeps.

Defined results. Null or empty text: no words, fails the length filter only (and the duplicate filter, if such a text has a smaller id).
Null part: the empty string. Null ids: such a row is no earlier copy and has none; it has no labels. Repeated rows count each; equal ids are not
earlier than one another. Repeated labels: one that says so is enough. A part without documents has no rows; empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeflow.session import materialize

from .base import WORD, text_of

#: An audit has k! orders.
MOST_FILTERS = 8
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5

SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_filters(words: Column, text: Column) -> dict[str, Column]:
    """Failure conditions on a text and its words: too short, repetitive, loud, marked up."""
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * LEAST_DISTINCT,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MOST_CAPITALS,
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(conditions: list[Column]) -> Column:
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def failure_masks(docs: DataFrame, part: str = "source") -> tuple[DataFrame, str]:
    """((doc_id, part, mask) of every row, letters of the mask's bits); the last filter finds copies of a smaller id's text.

    The text is read once; a digest stands for it from there on.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    split = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    filters = text_filters(F.col("words"), F.col("text"))
    judged = split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _mask(list(filters.values())).alias("mask"))
    narrow = materialize(judged, "audit-masks")
    copied = narrow.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    last = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(filters))).otherwise(F.lit(0))
    masks = narrow.join(copied, "digest", "left").select("doc_id", "part", (F.col("mask") + last).alias("mask"))
    return masks, "".join(filters) + "E"


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many documents, good ones and toxic ones have it."""
    said = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    both = masks.join(said, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


class Diagram:
    """A decision diagram over masks. Node ids index ``passing``, ``failing`` and ``weight``; ``levels`` finds a node by its children."""

    def __init__(self, weights: dict[int, tuple[int, ...]], letters: str) -> None:
        self.order = list(letters)
        self.passing: list[int] = []
        self.failing: list[int] = []
        self.weight: list[np.ndarray] = []
        self.levels: list[dict] = [{} for _ in letters]
        self.leaves: dict[tuple[int, ...], int] = {}
        width = len(next(iter(weights.values()), (0,)))
        below = [self._leaf(weights.get(m, (0,) * width)) for m in range(1 << len(letters))]
        for level in reversed(range(len(letters))):
            half = 1 << level  # bit of this level's filter; lower bits are decided above
            below = [self._node(level, below[m], below[m + half]) for m in range(half)]
        self.root = below[0]

    def _new(self, passing: int, failing: int, weight: np.ndarray) -> int:
        self.passing.append(passing)
        self.failing.append(failing)
        self.weight.append(weight)
        return len(self.weight) - 1

    def _leaf(self, weight: tuple[int, ...]) -> int:
        if weight not in self.leaves:
            self.leaves[weight] = self._new(-1, -1, np.array(weight, np.int64))
        return self.leaves[weight]

    def _node(self, level: int, passing: int, failing: int) -> int:
        known = self.levels[level]
        if (passing, failing) not in known:
            known[passing, failing] = self._new(passing, failing, self.weight[passing] + self.weight[failing])
        return known[passing, failing]

    def swap(self, level: int) -> None:
        """Exchange a level with the next. Its nodes stay the same functions, so nothing above changes."""
        uppers, self.levels[level], self.levels[level + 1] = list(self.levels[level].values()), {}, {}
        for u in uppers:
            p, f = self.passing[u], self.failing[u]
            self.passing[u], self.failing[u] = (
                self._node(level + 1, side[p], side[f]) for side in (self.passing, self.failing)
            )
            self.levels[level][self.passing[u], self.failing[u]] = u
        self.order[level : level + 2] = reversed(self.order[level : level + 2])

    def all_pass_path(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(kept, removed) of every step of the present order."""
        node, steps = self.root, []
        for _ in self.order:
            steps.append((self.weight[self.passing[node]], self.weight[self.failing[node]]))
            node = self.passing[node]
        return steps


def neighbouring_orders(letters: str) -> Iterator[str]:
    """All orders, each by one exchange of neighbours from the one before: the last letter sweeps to and fro through the orders of the others."""
    if len(letters) < 2:
        yield letters
        return
    for k, rest in enumerate(neighbouring_orders(letters[:-1])):
        places = range(len(letters))
        for at in places if k % 2 else reversed(places):
            yield rest[:at] + letters[-1] + rest[at:]


def audited(weights: dict[int, tuple[int, int, int]], letters: str) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part."""
    diagram, found = Diagram(weights, letters), []
    for order in neighbouring_orders(letters):
        at = next((i for i, (a, b) in enumerate(zip(diagram.order, order)) if a != b), None)
        if at is not None:
            diagram.swap(at)
        found += [(order, i, kept, removed) for i, (kept, removed) in enumerate(diagram.all_pass_path())]
    # A filter that comes first removes all it fails, and one that comes last what nothing else fails.
    fails = {order[0]: int(removed[0]) for order, i, _, removed in found if i == 0}
    alone = {order[i]: int(removed[0]) for order, i, _, removed in found if i == len(letters) - 1}
    shares = dict.fromkeys(letters, 0)
    for order, i, _, removed in found:
        shares[order[i]] += int(removed[0])
    return [
        (order, i + 1, int(kept[0]), int(removed[0]), fails[x] - int(removed[0]), alone[x], int(removed[1]), int(removed[2]), shares[x])
        for order, i, kept, removed in found
        for x in order[i]
    ]


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order and step; a part's group is its masks, at most 2^k rows."""
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"an audit has k! orders: at most {MOST_FILTERS} filters")
    names = [f.name for f in _arrow_schema()]

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        weights = dict(zip(rows["mask"], zip(rows["n"], rows["good"], rows["toxic"])))
        found = list(zip(*audited(weights, letters)))
        columns = [pa.array([rows["part"][0]] * len(found[0])), *map(pa.array, found)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, _arrow_schema())], names=names)

    return counts.groupBy("part").applyInArrow(run, SCHEMA)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the text filters A to D and of E, copies of a smaller id's text."""
    masks, letters = failure_masks(docs, part)
    return audit(mask_counts(masks, labels), letters)
