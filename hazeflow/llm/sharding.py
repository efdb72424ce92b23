"""Sharding by best-fit decreasing: indivisible groups, largest first, into the tightest bin that still holds them.

The bins' remaining capacities are kept in a balanced search tree, so an item costs
a logarithmic search. Items are the groups of equal texts. Groups of at least
1/512 of a shard stand alone: there are at most 512 times as many of them as shards,
whatever the table's size. All smaller groups are gathered by a hash of their
text into as many buckets, and a bucket is one item. So the packing, which is sequential, sees
a number of items that does not grow with the table, and equal texts never part.

The capacity is the smallest, to one part in a thousand, at which the items fit. A group larger than an even share
gets a shard of its own, and the rest is shared evenly over the other shards.

Defined results. Null text: as an empty one (size 1). Null or repeated ids: rows like any
other. Fewer groups than shards: the last shards stay empty. Empty table: no rows.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from hazeflow.session import materialize

from .base import text_of, with_columns_of

GRAIN = 512
#: Rows numbered together.
RUN_ROWS = 1000


class CapacityTree:
    """A treap of (remaining capacity, bin); balanced in expectation, with fixed seed."""

    __slots__ = ("root", "_random")

    def __init__(self) -> None:
        self.root, self._random = None, random.Random(7)

    def insert(self, key: tuple[int, int]) -> None:
        def split(node):
            if node is None:
                return None, None
            if node[0] < key:
                a, b = split(node[3])
                return [node[0], node[1], node[2], a], b
            a, b = split(node[2])
            return a, [node[0], node[1], b, node[3]]

        left, right = split(self.root)
        self.root = _merge(_merge(left, [key, self._random.random(), None, None]), right)

    def take_at_least(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest entry with room for ``size``."""
        best, node = None, self.root
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            self.root = _without(self.root, best)
        return best


def _merge(a, b):
    if a is None or b is None:
        return a or b
    if a[1] < b[1]:
        return [a[0], a[1], a[2], _merge(a[3], b)]
    return [b[0], b[1], _merge(a, b[2]), b[3]]


def _without(node, key):
    if node[0] == key:
        return _merge(node[2], node[3])
    if key < node[0]:
        return [node[0], node[1], _without(node[2], key), node[3]]
    return [node[0], node[1], node[2], _without(node[3], key)]


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin of each item; ``sizes`` must descend and not exceed ``capacity``. Opens a bin only when none has room."""
    tree, bins, opened = CapacityTree(), [], 0
    for size in sizes:
        found = tree.take_at_least(size)
        if found is None:
            found, opened = (capacity, opened), opened + 1
        tree.insert((found[0] - size, found[1]))
        bins.append(found[1])
    return bins


def even_bins(sizes: Sequence[int], n: int) -> list[int]:
    """Bins 0 to n-1 of items in descending order, as even as whole items allow."""
    total, alone = sum(sizes), 0
    while alone < len(sizes) and alone < n - 1 and sizes[alone] * (n - alone) > total:
        total -= sizes[alone]
        alone += 1
    rest = sizes[alone:]
    if not rest:
        return list(range(alone))
    fair = max(-(-total // (n - alone)), rest[0])
    # Steps of a thousandth; twice the fair share always suffices.
    capacities = [fair + fair * k // 1000 for k in range(1001)]
    tried: dict[int, list[int]] = {}

    def fits(k: int) -> bool:
        tried[k] = best_fit_decreasing(rest, capacities[k])
        return max(tried[k]) < n - alone

    k = bisect_left(range(1001), True, key=fits)
    return [*range(alone), *(alone + b for b in (tried[k] if k in tried else best_fit_decreasing(rest, capacities[k])))]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_size", F.octet_length(text_of(text)).cast("bigint") + 1).withColumn(
        "_digest", F.unhex(F.md5(text_of(text).cast("binary")))
    )


def _bucket(n_shards: int):
    return F.pmod(F.xxhash64("_digest"), F.lit(n_shards * GRAIN)).cast("string")


def pack(keyed: DataFrame, n_shards: int) -> tuple[DataFrame, DataFrame]:
    """The large groups (_big: digest) and the items (_item, shard, items' rows and the slots before them)."""
    spark = keyed.sparkSession
    groups = materialize(keyed.groupBy("_digest").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    unit = max(1, -(-total // (n_shards * GRAIN)))
    big = F.col("bytes") >= unit
    item = F.when(big, F.hex("_digest")).otherwise(_bucket(n_shards))
    items = groups.groupBy(item.alias("_item")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    # At most 2 * GRAIN items per shard.
    packed = sorted(items.collect(), key=lambda r: (-r["bytes"], r["_item"]))
    bins = even_bins([r["bytes"] for r in packed], n_shards) if packed else []
    filled, rows = [0] * n_shards, []
    for r, shard in zip(packed, bins):
        rows.append((r["_item"], shard, r["n"], filled[shard]))
        filled[shard] += r["n"]
    schema = T.StructType([
        T.StructField("_item", T.StringType()), T.StructField("shard", T.IntegerType()),
        T.StructField("_n", T.LongType()), T.StructField("_before", T.LongType()),
    ])
    return groups.where(big).select(F.col("_digest").alias("_big")), spark.createDataFrame(rows, schema)


def placed(keyed: DataFrame, n_shards: int) -> DataFrame:
    """``keyed`` rows with _item, shard, _n, _before. Both joined tables have at most 2 * GRAIN rows per shard, hence the broadcasts."""
    big, items = pack(keyed.select("_digest", "_size"), n_shards)
    found = keyed.join(F.broadcast(big), F.col("_digest") == F.col("_big"), "left")
    named = found.withColumn("_item", F.when(F.col("_big").isNotNull(), F.hex("_digest")).otherwise(_bucket(n_shards)))
    return named.drop("_big").join(F.broadcast(items), "_item")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """``docs`` with ``shard``. Texts are not shuffled."""
    wrapped = docs.select(F.struct("*").alias("_doc"))
    out = placed(_keyed(wrapped, "_doc.text"), n_shards)
    return with_columns_of(out.select("_doc.*", F.col("shard").alias("_shard")), shard=F.col("_shard")).drop("_shard")


def shard_slots(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size (bytes and 1), text_crc32, shard, and its slot, gapless from 0 in the shard.

    Slots follow items, then runs of some thousand rows of an item, so that a group
    of very many copies is numbered by many tasks.
    """
    rows = _keyed(docs.select("doc_id", "text"), "text").select("doc_id", "_size", F.crc32(text_of().cast("binary")).alias("text_crc32"), "_digest")
    out = placed(materialize(rows, "shard-rows"), n_shards)
    runs = F.ceil(F.col("_n") / F.lit(RUN_ROWS)).cast("bigint")
    out = out.withColumn("_run", F.pmod(F.xxhash64("doc_id", "text_crc32"), runs))
    counts = out.groupBy("_item", "_run").agg(F.count(F.lit(1)).alias("_c"))
    earlier = F.sum("_c").over(W.partitionBy("_item").orderBy("_run")) - F.col("_c")
    starts = counts.select("_item", "_run", earlier.alias("_start"))
    at = F.row_number().over(W.partitionBy("_item", "_run").orderBy("doc_id", "text_crc32", "_size")) - 1
    numbered = out.withColumn("_at", at).join(starts, ["_item", "_run"])
    return numbered.select(
        "doc_id", F.col("_size").alias("size"), "text_crc32", "shard", (F.col("_before") + F.col("_start") + F.col("_at")).alias("slot")
    )
