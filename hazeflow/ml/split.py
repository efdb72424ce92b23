"""Train/test split and folds by a hash of the row's key.

With ``split`` and ``with_fold`` a row's side depends on its key alone: not on the order or partitioning of the
table, nor on which other rows are there. ``exact_split`` and ``with_exact_fold`` cut the table, in the order of that hash, into parts of
a given size instead. Where to cut is found by counting rows per stretch of the hash and looking closer at the stretch
that holds a cut, 16 bits at a time: narrow aggregates, no sort, and no row moves. Bits that all rows of a stretch share need no pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import KEY_COLS

TEST_PERCENT = 20
SPLIT_SEED = 42
FOLD_SEED = 43
#: Bits of an order that one counting pass tells apart: at most 65,536 counts per cut reach the driver.
DIGIT = 16
LONGEST = 2**63 - 1
#: Equal rows that one task writes where a cut goes through them.
RUN = 1 << 20


def hash_bucket(keys: list[str], seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(buckets)).cast("int")


def linear_bucket(terms: dict[str, int], seed: int, buckets: int) -> Column:
    """A bucket from integer columns and multipliers, for engines without the hash."""
    total = F.lit(seed).cast("bigint")
    for name, factor in terms.items():
        total = total + F.col(name) * F.lit(factor)
    return F.pmod(total, F.lit(buckets))


def with_split(df: DataFrame, bucket: Column | None = None, test_percent: int = TEST_PERCENT) -> DataFrame:
    bucket = hash_bucket(KEY_COLS, SPLIT_SEED, 100) if bucket is None else bucket
    return df.withColumn("split", F.when(bucket < test_percent, F.lit("test")).otherwise(F.lit("train")))


def split(df: DataFrame, bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, bucket)
    return marked.where("split = 'train'").drop("split"), marked.where("split = 'test'").drop("split")


def split_by_time(df: DataFrame, start_of_test: int) -> tuple[DataFrame, DataFrame]:
    """Everything before an epoch millisecond to train on, the rest to test on."""
    return df.where(F.col("timestamp") < start_of_test), df.where(F.col("timestamp") >= start_of_test)


def with_fold(df: DataFrame, folds: int = 3, bucket: Column | None = None, name: str = "fold") -> DataFrame:
    return df.withColumn(name, hash_bucket(KEY_COLS, FOLD_SEED, folds) if bucket is None else bucket)


# --- parts of exact size ---


@dataclass
class _Cut:
    """The last place of the first ``k`` rows: known values of the order's columns, then leading bits of the next one."""

    k: int
    below: int = 0
    known: tuple[int, ...] = ()
    prefix: int = 0
    shift: int = 64
    done: bool = False
    tied: bool = False

    def group(self, level: list[str]) -> Column:
        """Rows that share what is known of the cut."""
        own = F.lit(True)
        for name, value in zip(level, self.known):
            own = own & (F.col(name) == value)
        return own if self.shift == 64 else own & (F.shiftright(level[len(self.known)], self.shift) == self.prefix)

    def narrow(self, found: dict[int, tuple[int, list[tuple[int, int]]]], shift: int) -> None:
        """Take the stretch that holds row ``k``, given per stretch its number of rows and the least and largest value in each column."""
        for prefix in sorted(found):
            count, ranges = found[prefix]
            if self.below + count >= self.k:
                break
            self.below += count
        if self.below + count == self.k:
            # The stretch ends at the cut.
            last = (prefix << shift) + (1 << shift) - 1
            self.known, self.done = (*self.known, last, *[LONGEST] * (len(ranges) - len(self.known) - 1)), True
            return
        # Columns with one value in the stretch are known, and so are the leading bits that all values of the next one share.
        while len(self.known) < len(ranges) and len(set(ranges[len(self.known)])) == 1:
            self.known = (*self.known, ranges[len(self.known)][0])
        self.done = self.tied = len(self.known) == len(ranges)
        if not self.done:
            low, high = ranges[len(self.known)]
            self.shift = 64 if low < 0 <= high else (low ^ high).bit_length()
            self.prefix = low >> self.shift


def _stretches(rows: DataFrame, level: list[str], depth: int, shift: int) -> list[tuple[tuple[int, ...], int, tuple[int, list[tuple[int, int]]]]]:
    """(values of the columns before, leading bits of the next, (rows, ranges)) of all stretches."""
    ranges = F.array(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")) for c in level])
    grouped = rows.groupBy(*level[:depth], F.shiftright(level[depth], shift).alias("digit"))
    found = grouped.agg(F.count(F.lit(1)).alias("n"), ranges.alias("ranges")).collect()
    return [(tuple(r[:depth]), r["digit"], (r["n"], [tuple(x) for x in r["ranges"]])) for r in found]


def _cuts(rows: DataFrame, level: list[str], sizes: Callable[[int], list[int]]) -> list[_Cut]:
    """A cut behind each of the given numbers of rows; ``sizes`` gets the number of all rows."""
    first = {digit: told for _, digit, told in _stretches(rows, level, 0, 64 - DIGIT)}
    n = sum(count for count, _ in first.values())
    cuts = [_Cut(min(max(k, 0), n)) for k in sizes(n)]
    for cut in cuts:
        if cut.k in (0, n):
            cut.known, cut.done = (), True
        else:
            cut.narrow(first, 64 - DIGIT)
    while any(not c.done for c in cuts):
        # Cuts that know equally much share a pass.
        opened = {}
        for cut in (c for c in cuts if not c.done):
            opened.setdefault((len(cut.known), cut.shift), []).append(cut)
        for (depth, shift), own in opened.items():
            finer, near = max(0, shift - DIGIT), F.lit(False)
            for cut in own:
                near = near | cut.group(level)
            found = _stretches(rows.where(near), level, depth, finer)
            for cut in own:
                mine = {d: told for known, d, told in found if known == cut.known and (shift == 64 or d >> (shift - finer) == cut.prefix)}
                cut.narrow(mine, finer)
    return cuts


def _after(level: list[str], place: tuple[int, ...]) -> Column:
    """Whether a row lies behind a place of the order."""
    behind, same = F.lit(False), F.lit(True)
    for name, value in zip(level, place):
        behind, same = behind | (same & (F.col(name) > value)), same & (F.col(name) == value)
    return behind


def in_parts(df: DataFrame, sizes: Callable[[int], list[int]], order: list[Column], name: str) -> DataFrame:
    """``df`` with the number of its part: part 0 are the first rows in ``order``, and a cut lies behind each of the
    ascending numbers of rows that ``sizes`` makes of their count.

    ``order`` are integer columns, compared in turn; a null comes first. Rows that are equal in all of them follow a hash of all their columns, so that
    which other rows are in a task never matters. Repeated rows count each: where a cut goes through them, as many as fit go to either side.
    An empty table has no part. A column called ``name`` is replaced. ``df`` is read, these columns only, until the rows
    about a cut are told apart: three times for a hash of 10^12 keys. So it should be a written table.
    """
    df = df.drop(name)
    level = [f"_order_{i}" for i in range(len(order) + 1)]
    every = [*(F.coalesce(c.cast("bigint"), F.lit(-LONGEST - 1)) for c in order), F.xxhash64(*df.columns)]
    rows = df.withColumns(dict(zip(level, every)))
    cuts = _cuts(rows.select(*level), level, sizes)
    whole = [c for c in cuts if c.known]
    always = sum(c.k == 0 for c in cuts)
    part = F.lit(always)
    for cut in whole:
        part = part + _after(level, cut.known).cast("int")
    ties = {c.known: c.below for c in whole if c.tied}
    loose = rows.withColumn(name, part)
    for place in ties:
        loose = loose.where(~_at(level, place))
    out = loose.drop(*level)
    for place, start in ties.items():
        out = out.unionByName(_dealt(rows.where(_at(level, place)).drop(*level), start, [c.k for c in cuts], name))
    return out


def _at(level: list[str], place: tuple[int, ...]) -> Column:
    same = F.lit(True)
    for name, value in zip(level, place):
        same = same & (F.col(name) == value)
    return same


def _dealt(equal: DataFrame, start: int, ks: list[int], name: str) -> DataFrame:
    """Equal rows, the first of which is number ``start``, dealt to the parts by number: counted, then written out again in runs.

    Only rows whose hashes of all columns collide can differ here, so the window sees one or two rows.
    """
    kinds = equal.groupBy(*equal.columns).agg(F.count(F.lit(1)).alias("_n"))
    first = F.lit(start) + F.sum("_n").over(W.orderBy(*equal.columns)) - F.col("_n")
    edges = [0, *ks, LONGEST]
    parts = [
        F.struct(F.lit(i).alias("part"), (F.least(F.lit(b), F.col("_first") + F.col("_n")) - F.greatest(F.lit(a), F.col("_first"))).alias("take"))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    shares = kinds.withColumn("_first", first).withColumn("_share", F.explode(F.array(*parts))).where("_share.take > 0")
    runs = shares.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_share.take") - 1) / F.lit(RUN))))).repartition("_share.part", "_run")
    length = F.least(F.lit(RUN), F.col("_share.take") - F.col("_run") * F.lit(RUN))
    return runs.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), length))).select(*equal.columns, F.col("_share.part").alias(name))


def key_order(seed: int) -> list[Column]:
    return [F.xxhash64(*KEY_COLS, F.lit(seed))]


def with_exact_split(df: DataFrame, test_share: float = TEST_PERCENT / 100, order: list[Column] | None = None) -> DataFrame:
    """``df`` with ``split``: exactly ``ceil(test_share * n)`` rows to test on. One row alone is left to train on."""
    # A share is a decimal: 0.2 * 15 is 3, not a little more.
    size = lambda n: [min(math.ceil(round(test_share * n, 6)), max(n - 1, 0))]
    parts = in_parts(df, size, order or key_order(SPLIT_SEED), "split")
    return parts.withColumn("split", F.when(F.col("split") == 0, "test").otherwise("train"))


def exact_split(df: DataFrame, test_share: float = TEST_PERCENT / 100, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exact sizes."""
    marked = with_exact_split(df, test_share, order)
    return marked.where("split = 'train'").drop("split"), marked.where("split = 'test'").drop("split")


def with_exact_fold(df: DataFrame, folds: int = 3, order: list[Column] | None = None, name: str = "fold") -> DataFrame:
    """``df`` with a fold of 0 to ``folds - 1``; sizes differ by one at most, and the first folds are the larger ones."""
    if folds < 2:
        raise ValueError("at least two folds")
    return in_parts(df, lambda n: [i * (n // folds) + min(i, n % folds) for i in range(1, folds)], order or key_order(FOLD_SEED), name)
