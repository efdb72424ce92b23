"""Forests whose nodes the driver never holds: written by the tasks that grow them, read by the tasks that score.

A forest of unlimited depth has up to two nodes per training row and tree. Here each task gets the blocks of training rows once and grows some of the
trees to their end, by the sums and splits of ``trees``, so the trees are the same. Its nodes are written to the shared folder, a tree as stretches
of nodes. To score, rows and trees meet in tasks of some trees and at most ``ALONE_ROWS`` rows each; a task holds one tree at a time. The sums of its trees
come back as one number per row.

A search measures a fold's forest where its trees are grown, on the held-out rows that came with the others: nothing of it is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import trees as T
from .trees import NODE_COLUMNS, NODE_SCHEMA, Block, Growth, Spec, TreeModel, WholeTree, binned, breadth_first, row_weights, walk, whole_tree

STORED = "tree int, stretch int, feature binary, bin binary, g binary, h binary, n binary"
PIECES = ["feature", "bin", "g", "h", "n"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row: a row has some MB, so no batch is turned into Python values whole."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _dealt(growth: Growth, n_tasks: int) -> DataFrame:
    """The blocks once for every task."""
    stored = growth.stored.select(F.monotonically_increasing_id().alias("at"), "n", "key", "bins", "y", "fold")
    return stored.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1)))).repartitionById(n_tasks, "task")


class _Share:
    """What a task gets: the rows that train, block by block, and those held out."""

    def __init__(self, batches: Iterator[pa.RecordBatch], spec: Spec, n_inputs: int) -> None:
        own, held, self.task = [], [], None
        for row in _rows(batches):
            self.task = row["task"]
            block = Block.of(row, n_inputs, 0)
            trains = block.fold != spec.fold
            own.append((block.key[trains], block.bins[trains], block.y[trains]))
            held.append((row["at"], block.bins[~trains], block.y[~trains]))
        self.key, self.bins, self.y = (np.concatenate(x) for x in zip(*own)) if own else (None, None, None)
        self.held = sorted((x for x in held if len(x[2])), key=itemgetter(0))

    def trees(self, numbers: range, spec: Spec, base: float, scale: float) -> Iterator[tuple[int, WholeTree]]:
        gradient = np.rint((base - self.y) * scale).astype(np.int64)
        for number in numbers:
            weight = row_weights(self.key, spec, number)
            rows = np.flatnonzero(weight)
            weight = weight[rows]
            yield number, whole_tree(self.bins[rows], gradient[rows] * weight, weight, scale, spec)


def _numbers(task: int, n_tasks: int, trees: int) -> range:
    return range(task * trees // n_tasks, (task + 1) * trees // n_tasks)


def write_forest(growth: Growth, cols: list[str], edges: list[list[float]], trees: int | None = None, depth: int | None = None, least_rows: int | None = None) -> WrittenForest:
    """The forest of ``growth``, grown by tasks and written; the model is that of its first ``trees``, stopped at ``depth`` and below ``least_rows`` rows."""
    spec, base, scale, n_inputs = growth.specs[0], growth.base[0], growth.scale, growth.n_inputs
    n_trees = spec.trees if trees is None else trees
    n_tasks = max(1, min(n_trees, growth.cores))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = _Share(batches, spec, n_inputs)
        if share.task is None:
            return
        for number, tree in share.trees(_numbers(share.task, n_tasks, n_trees), spec, base, scale):
            for k, pieces in enumerate(tree.packed()):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([k], pa.int32()), *[pa.array([x], pa.binary()) for x in pieces]], names=["tree", "stretch", *PIECES])

    stored = materialize(_dealt(growth, n_tasks).mapInArrow(grow, STORED), "forest")
    growth.levels += 1
    growth.units.unpersist()
    return WrittenForest(cols, base, edges, stored, spec, n_trees, scale, depth, spec.least_rows if least_rows is None else least_rows)


def held_out_errors(growth: Growth, variants: list[tuple[int, int, int | None, int]]) -> list[tuple[float, float, float, int]]:
    """What ``Growth.squared_errors`` says of a grown forest, in one job that grows it and measures each tree on the held-out rows."""
    spec, base, scale, n_inputs = growth.specs[0], growth.base[0], growth.scale, growth.n_inputs
    todo, counts = sorted({(d, k) for _, _, d, k in variants}, key=str), sorted({t for _, t, _, _ in variants})
    n_tasks = max(1, min(counts[-1], growth.cores))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = _Share(batches, spec, n_inputs)
        if not share.held:
            return
        bins = np.concatenate([x[1] for x in share.held])
        numbers, ends = _numbers(share.task, n_tasks, counts[-1]), np.cumsum([len(x[2]) for x in share.held])
        # Sums up to the next of the counts each.
        upto = lambda number: int(np.searchsorted(counts, number + 1))
        for part, some in groupby(share.trees(numbers, spec, base, scale), key=lambda x: upto(x[0])):
            total = np.zeros((len(todo), len(bins)))
            for _, tree in some:
                value = tree.values(scale, spec)
                for i, (d, k) in enumerate(todo):
                    total[i] += value[walk(bins, 0, tree.feature, tree.bin, tree.stopped(d, k))]
            for (at, _, y), b in zip(share.held, ends):
                packed = (y, total[:, b - len(y) : b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), pa.array([part], pa.int32()), pa.array([share.task], pa.int32()), *[pa.array([np.ascontiguousarray(x).astype("<f8").tobytes()], pa.binary()) for x in packed]],
                    names=["at", "part", "task", "y", "total"],
                )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, of_block in groupby(_rows(batches), key=itemgetter("at")):
            total = 0.0
            for part, some in groupby(of_block, key=itemgetter("part")):
                for row in some:
                    y = np.frombuffer(row["y"], "<f8")
                    total = total + np.frombuffer(row["total"], "<f8").reshape(len(todo), len(y))
                error = np.square(base + total / counts[part] - y).sum(axis=1)
                found = [{"variant": i, "trees": counts[part], "sse": float(e), "sy": float(y.sum()), "syy": float(np.square(y).sum()), "n": len(y)} for i, e in enumerate(error)]
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("variant", pa.int32()), ("trees", pa.int32()), ("sse", pa.float64()), ("sy", pa.float64()), ("syy", pa.float64()), ("n", pa.int64())]))

    sums = _dealt(growth, n_tasks).mapInArrow(measure, "at long, part int, task int, y binary, total binary")
    found = sums.repartition(growth.parts, "at").sortWithinPartitions("at", "part", "task").mapInArrow(add_up, "variant int, trees int, sse double, sy double, syy double, n long")
    by = {(*todo[r.variant], r.trees): (r.sse, r.sy, r.syy, r.n) for r in found.groupBy("variant", "trees").agg(*[F.sum(c).alias(c) for c in ("sse", "sy", "syy", "n")]).collect()}
    growth.levels += 1
    growth.units.unpersist()
    return [by.get((d, k, t), (0.0, 0.0, 0.0, 0)) for _, t, d, k in variants]


class WrittenForest(TreeModel):
    """A forest in the shared folder. ``transform`` and ``save`` leave its nodes there; ``nodes`` brings them to the driver."""

    def __init__(self, cols: list[str], base: float, edges: list[list[float]], stored: DataFrame, spec: Spec, trees: int, scale: float, depth: int | None, least_rows: int) -> None:
        self.cols, self.base, self.edges, self.stored = list(cols), base, edges, stored
        self.spec, self.trees, self.scale, self.depth, self.least_rows = spec, trees, scale, depth, least_rows

    @property
    def nodes(self) -> pd.DataFrame:
        return TreeModel(self.cols, self.base, self.node_table(self.stored.sparkSession).toPandas()).nodes

    def node_table(self, spark: SparkSession) -> DataFrame:
        edges, spec, trees, scale, depth, least = self.edges, self.spec, self.trees, self.scale, self.depth, self.least_rows
        limit = np.zeros((len(edges), T.BINS))
        for i, e in enumerate(edges):
            limit[i, : len(e)] = e

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, some in groupby(_rows(batches), key=itemgetter("tree")):
                tree = WholeTree.unpacked([tuple(r[c] for c in PIECES) for r in some])
                left = tree.stopped(depth, least)
                order = breadth_first(left)
                inner = left[order] >= 0
                feature, value, gain = np.where(inner, tree.feature[order], -1), tree.values(scale, spec)[order] / trees, tree.gains(left, scale)[order]
                table = (
                    np.full(len(order), number), np.arange(len(order)), feature, np.where(inner, limit[feature, tree.bin[order]], 0.0),
                    np.where(inner, 2 * np.cumsum(inner) - 1, -1), gain, tree.n[order], tree.h[order], value,
                )
                kinds = ("int32", "int32", "int32", "float64", "int32", "float64", "int64", "int64", "float64")
                for a in range(0, len(order), T.STRETCH):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + T.STRETCH].astype(k)) for x, k in zip(table, kinds)], names=NODE_COLUMNS)

        n_tasks = min(trees, spark.sparkContext.defaultParallelism)
        own = self.stored.where(F.col("tree") < trees)
        return own.repartition(n_tasks, "tree").sortWithinPartitions("tree", "stretch").mapInArrow(decode, NODE_SCHEMA)

    def importance(self) -> dict[str, float]:
        gains = self.node_table(self.stored.sparkSession).where("feature >= 0").groupBy("feature").agg(F.sum("gain").alias("gain"))
        by = {r.feature: r.gain for r in gains.collect()}
        total = sum(by.values()) or 1.0
        return {c: float(by.get(i, 0.0) / total) for i, c in enumerate(self.cols)}

    def transform(self, df: DataFrame) -> DataFrame:
        """``df``, written once, with ``prediction``; NULL where an input is missing. Rows and trees meet in tasks, and the sums go back to their rows."""
        spark, mark = df.sparkSession, "_row"
        while mark in df.columns:
            mark += "_"
        rows = materialize(df.withColumn(mark, F.monotonically_increasing_id()), "forest-rows")
        scores = self._scores(rows.select(F.col(mark).alias("row"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.cols)]).dropna(), spark)
        scored = rows.drop("prediction").join(scores.withColumnRenamed("row", mark), mark, "left")
        return scored.select(*df.columns, *[c for c in ["prediction"] if c not in df.columns])

    def _scores(self, inputs: DataFrame, spark: SparkSession) -> DataFrame:
        """(row, prediction) of rows without a missing input."""
        edges, spec, trees, scale, base, depth, least, n_inputs = self.edges, self.spec, self.trees, self.scale, self.base, self.depth, self.least_rows, len(self.cols)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, T.BLOCK_ROWS):
                    part = batch.slice(a, T.BLOCK_ROWS)
                    row, *x = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                    packed = [row.astype("<i8"), binned(np.stack(x, axis=1), edges)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(row[0])]), pa.array([len(row)], pa.int64()), *[pa.array([p.tobytes()], pa.binary()) for p in packed]], names=["block", "n", "row", "bins"])

        blocks = materialize(inputs.mapInArrow(pack, "block long, n long, row binary, bins binary"), "forest-blocks")
        chunks = max(1, -(-int(blocks.agg(F.sum("n")).first()[0] or 0) // T.ALONE_ROWS))
        groups = max(1, min(trees, spark.sparkContext.defaultParallelism // chunks))
        each = F.sequence(F.lit(0), F.lit(groups - 1))
        # A chunk's rows go to all groups of trees, a group's trees to all chunks of rows. Rows come before trees.
        ours = blocks.select(F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(-1).alias("tree"), F.lit(0).alias("stretch"), "block", "row", "bins", *[F.lit(None).cast("binary").alias(c) for c in PIECES])
        ours = ours.withColumn("group", F.explode(each))
        theirs = self.stored.where(F.col("tree") < trees).select(
            F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "tree", "stretch", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("row"),
            F.lit(None).cast("binary").alias("bins"), *PIECES, F.floor(F.col("tree") * F.lit(groups) / F.lit(trees)).cast("int").alias("group"),
        )

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, bins, total, group = [], None, None, 0
            for number, some in groupby(_rows(batches), key=itemgetter("tree")):
                if number < 0:
                    for r in some:
                        held.append((r["block"], r["row"], np.frombuffer(r["bins"], np.uint8).reshape(-1, n_inputs)))
                        group = r["group"]
                    bins = np.concatenate([x[2] for x in held])
                    total = np.zeros(len(bins))
                    held = [(block, row, len(own)) for block, row, own in held]
                    continue
                if not held:
                    return
                tree = WholeTree.unpacked([tuple(r[c] for c in PIECES) for r in some])
                total += tree.values(scale, spec)[walk(bins, 0, tree.feature, tree.bin, tree.stopped(depth, least))] / trees
            a = 0
            for block, row, n in held:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([group], pa.int32()), pa.array([row], pa.binary()), pa.array([total[a : a + n].astype("<f8").tobytes()], pa.binary())], names=["block", "group", "row", "total"])
                a += n

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, some in groupby(_rows(batches), key=itemgetter("block")):
                total = base
                for r in some:
                    total = total + np.frombuffer(r["total"], "<f8")
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["row"], "<i8")), pa.array(total)], names=["row", "prediction"])

        met = ours.unionByName(theirs).withColumn("p", F.col("chunk") * F.lit(groups) + F.col("group"))
        sums = met.repartitionById(chunks * groups, "p").sortWithinPartitions("tree", "stretch").mapInArrow(score, "block long, group int, row binary, total binary")
        return sums.repartition("block").sortWithinPartitions("block", "group").mapInArrow(add_up, "row long, prediction double")
