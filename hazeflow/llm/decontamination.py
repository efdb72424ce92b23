"""Benchmark decontamination: MinHash containment search by size, verified exactly.

An item leaks into a document if the document has at least ``threshold`` of the item's distinct
five-word shingles. Items are partitioned by their number of shingles (powers of two). Of
each item, the shingles with the smallest hashes form its sketch, and the sketch length of a
partition is taken at its largest size u: floor((1 - threshold) * u) + 1. An item that
leaks misses fewer shingles than that, so at least one of its sketch is found in the document: no leak is
lost, however long the document. A document probes only the partitions it is large enough for,
by binary search of its shingle hashes; candidates are counted by hashes, then by the shingles themselves.

The usual form keeps MinHash signatures of the long side and tunes banding per partition. With
items of tens and documents of ten thousands of shingles, the Jaccard similarity is so
small that banding loses most leaks, hence the sketch on the items' side.

The benchmark is the stated query set. It is read in blocks of bounded size, and each block is held by every task against
all documents. Documents are not shuffled.

Words: maximal runs of letters and digits, lower case. An item of fewer than five words has one shingle, all its words.

Defined results. Null, empty or wordless text on either side: never a leak. Null or repeated document ids: each row is
judged on its own. Equal (item_id, text) rows of the benchmark count once. Empty tables: no leaks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import shingle_hashes, word_shingles

WORDS = 5
THRESHOLD = 0.8
#: Characters of benchmark text in a block.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall((text or "").lower())]


def _needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


class ItemIndex:
    """Sketches of one block of items, by shingle width and size partition."""

    def __init__(self, items: list[tuple], threshold: float = THRESHOLD, words: int = WORDS) -> None:
        self.items, self.threshold = [], threshold
        sketches: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            own = words_of(text)
            if not own:
                continue
            width = min(words, len(own))
            joined, starts, ends = word_shingles(own, width)
            texts = {joined[a:b] for a, b in zip(starts, ends)}
            hashes = np.unique(shingle_hashes(own, width))
            partition = len(hashes).bit_length()
            length = min(len(hashes), math.floor((1 - threshold) * ((1 << partition) - 1) + 1e-9) + 1)
            for h in hashes[:length].tolist():
                sketches.setdefault(width, []).append((h, partition, len(self.items)))
            self.items.append((item_id, hashes, texts))
        self.tables = {}
        for width, rows in sketches.items():
            by_hash: dict[int, list[tuple[int, int]]] = {}
            for h, partition, item in rows:
                by_hash.setdefault(h, []).append((partition, item))
            self.tables[width] = (np.array(sorted(by_hash), np.uint64), by_hash)

    def leaks(self, text: str | None) -> list[tuple]:
        """(item_id, shingles shared, shingles of the item) of every item that leaks into the text."""
        own, found = words_of(text), []
        for width, (sketch, by_hash) in self.tables.items():
            if len(own) < width:
                continue
            hashes = shingle_hashes(own, width)
            at = np.minimum(np.searchsorted(sketch, hashes), len(sketch) - 1)
            hits = np.unique(hashes[sketch[at] == hashes])
            if not len(hits):
                continue
            hashes = np.unique(hashes)
            # Partitions whose smallest item is too large for this document are not looked into.
            items = {i for h in hits.tolist() for partition, i in by_hash[h] if self.threshold * (1 << (partition - 1)) <= len(hashes)}
            texts = None
            for i in sorted(items):
                item_id, of_item, shingles = self.items[i]
                if np.isin(of_item, hashes, assume_unique=True).sum() < _needed(len(of_item), self.threshold):
                    continue
                if texts is None:
                    joined, starts, ends = word_shingles(own, width)
                    texts = {joined[a:b] for a, b in zip(starts, ends)}
                shared = len(shingles & texts)
                if shared >= _needed(len(shingles), self.threshold):
                    found.append((item_id, shared, len(shingles)))
        return found


def _blocks(benchmark: DataFrame, threshold: float) -> Iterator:
    """Broadcast indexes of the benchmark, one block after the other."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(ItemIndex(rows, threshold))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every leak."""
    names = ["doc_id", "item_id", "n_shared", "n_shingles"]
    out = None
    for index in _blocks(benchmark, threshold):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d.as_py(), *leak) for d, t in zip(batch.column("doc_id"), batch.column("text")) for leak in index.value.leaks(t.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))
        out = found if out is None else out.unionByName(found)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that any item leaks into."""
    schema = docs.schema
    at = docs.columns.index("text")
    for index in _blocks(benchmark, threshold):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.value.leaks(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
