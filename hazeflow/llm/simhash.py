"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is mapped to the bit counts of its segments. Counts of a segment differ by no
more than its bits do, so the Manhattan distance of two such vectors is a lower bound of the
Hamming distance, and a range join of the vectors finds every pair. Segments are two bits
wide: wider ones give counts that too many fingerprints share. Counts are
kept in unary (00, 01, 11), which turns Manhattan into xor and a bit count.

The grid. The coordinates form six blocks. Vectors at Manhattan distance 2 or less agree in at
least four of them, so each vector enters one cell per choice of four blocks, the cell being its exact
coordinates there: 15 cells. A cell is worked on by one task, in which Manhattan distance and
then the fingerprints themselves are compared, and which returns a spanning forest of the cell, never all its pairs.

Crowded cells (families of near copies) go to a finer grid of the same kind: one-bit segments,
16 blocks, 14 of them fixed. Such a cell can hold 256 fingerprints at most, whatever the input.
Equal fingerprints are one throughout.

Defined results. Null or empty text, or white space only: fingerprint 0, linked like any other. Null ids belong to
their component but do not name it; a component of null ids has a null name. Repeated rows each
return. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeflow.session import materialize

from .base import parts
from .components import connected_components
from .shingles import shingle_hashes

WORDS = 3
DISTANCE = 2
CROWDED = 256
_EVEN = 0x5555555555555555
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_COLUMN = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit i is set if it is in more than half of the shingle hashes. Signed, as Spark's long."""
    hashes = shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), words)
    counts = np.zeros((8, 8), np.int64)
    for a in range(0, len(hashes), 1 << 18):
        octets = hashes[a : a + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((octets + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    set_bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_masks(blocks: int, free: int = DISTANCE) -> list[int]:
    """One mask per choice of ``free`` blocks to leave out; blocks of whole two-bit segments where possible."""
    unit = 2 if blocks <= 32 and 64 // blocks > 4 else 1
    cuts = [unit * round(64 / unit * k / blocks) for k in range(blocks + 1)]
    out = []
    for left in combinations(range(blocks), free):
        mask = sum(((1 << cuts[b + 1]) - (1 << cuts[b])) for b in range(blocks) if b not in left)
        out.append(_signed(mask))
    return out


def popcount_embedding(fp: Column) -> Column:
    """Counts of two-bit segments in unary: both bits sorted within their segment."""
    half = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(half).bitwiseAND(F.lit(_EVEN)), fp.bitwiseAND(half).bitwiseAND(F.lit(_EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _embedded(x: np.ndarray) -> np.ndarray:
    even = np.uint64(_EVEN)
    half = x >> np.uint64(1)
    return ((x | half) & even) | ((x & half & even) << np.uint64(1))


def _forest(cells: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span, within each run of equal cells, everything linked there. Cells are sorted."""
    n, ends, links = len(fps), [], []
    vectors = _embedded(fps)
    here = np.arange(n - 1)
    step = 1
    while len(here):
        here = here[here + step < n]
        here = here[cells[here] == cells[here + step]]
        near = here[np.bitwise_count(vectors[here] ^ vectors[here + step]) <= distance]  # Manhattan
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= distance]
        ends.append(near)
        links.append(near + step)
        step += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, links))
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _cell_links(keyed: DataFrame, distance: int) -> DataFrame:
    """Links within cells; a cell's rows meet in one task and are at most CROWDED many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def found(sig, cell, fp):
            new = np.r_[True, (sig[1:] != sig[:-1]) | (cell[1:] != cell[:-1])][: len(sig)]
            a, b = _forest(np.cumsum(new), fp.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = [np.concatenate((h, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64))) for h, c in zip(held, ("sig", "cell", "fp"))]
            new = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            whole = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            held = [r[whole:] for r in rows]
            if whole:
                yield found(*[r[:whole] for r in rows])
        if len(held[0]):
            yield found(*held)

    dealt = keyed.select("sig", "cell", "fp").repartition(parts(keyed.sparkSession), "sig", "cell").sortWithinPartitions("sig", "cell", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def _keyed(fps: DataFrame, vector: Column, masks: list[int]) -> DataFrame:
    cells = F.array(*[vector.bitwiseAND(F.lit(m).cast("bigint")) for m in masks])
    return fps.select("fp", F.posexplode(cells).alias("sig", "cell"))


def links(fps: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that connect all of the distinct ``fp`` that are within ``distance`` bits, directly or by others."""
    keyed = _keyed(fps, popcount_embedding(F.col("fp")), grid_masks(6 if distance == 2 else distance + 4, distance))
    sizes = keyed.groupBy("sig", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, ["sig", "cell"]), "simhash-cells")
    coarse = _cell_links(shared.where(F.col("n") <= crowded), distance)
    dense = shared.where(F.col("n") > crowded).select("fp").distinct()
    fine = _cell_links(_keyed(dense, F.col("fp"), grid_masks(16, distance)), distance)
    return coarse.unionByName(fine)


def components(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    fps = materialize(fingerprints(docs, words), "simhash-fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), distance))
    linked = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("fp", "root").join(names, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id, and of equal ids the smallest row hash.

    Components without any id keep all their rows.
    """
    found = components(docs).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("component_id") == F.col("doc_id"), 1).otherwise(0)).alias("_first")
    )
    wide = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"))
    joined = wide.join(found.withColumnRenamed("doc_id", "_found"), F.col("_id") == F.col("_found"), "left")
    kept = joined.where(F.col("_id").isNull() | (F.col("_first") == 1))
    once = kept.where(F.col("_id").isNull() | (F.col("_n") == 1)).select("_doc")
    # Repeated ids only: the row with the smallest hash, then the smallest of those.
    again = kept.where(F.col("_n") > 1).groupBy("_id").agg(F.min(F.struct(F.xxhash64("_doc").alias("h"), F.col("_doc"))).alias("m"))
    return once.unionByName(again.select(F.col("m._doc").alias("_doc"))).select("_doc.*")
