"""Approximate nearest neighbours by cosine: inverted lists scanned dimension by dimension.

Unit vectors are turned by a random rotation, after which any leading
coordinates are a fair sample of the whole. They lie in lists around k-means centres, and a
query probes the lists of its nearest centres. Within a list the vectors are read in blocks of columns. After each
block a hypothesis test on the distance so far (Gao and Long, 2023) drops the candidates that are too far with
near certainty; only survivors are scored, in double precision, on the original vectors.

Each query starts with a bound: the distance of its k-th nearest in the fit sample, among the lists it probes.

Settings: centres and bounds from at most ``SAMPLE`` vectors, those with the smallest hash of their id; sqrt(n) lists, 4096 at most;
``PROBED`` of them are probed (8 at least). Vectors without cluster structure need that many for a recall above 0.9.
Every vector is indexed. The queries are a stated set and go in blocks of ``QUERY_BLOCK``
to all tasks, each of which returns its best few per query.

Copies of one vector: only the k + 1 with the smallest ids can be in any result, so no more enter
the index, and equal queries are searched once.

Defined results. Vectors that are null, zero, or hold null or non-finite components, vectors without an id, and those of another length than
most take no part. Ties go to the smaller id. Repeated rows of one id and vector count once. Fewer than k candidates: all of them.
Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazeflow.session import materialize

from .base import parts

SAMPLE = 16_384
MOST_LISTS = 4096
PROBED = 0.6
QUERY_BLOCK = 4096
COLUMNS = 16
#: Errors of the test fall off as exp(-c * EPSILON^2).
EPSILON = 2.1
SEED = 11


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither huge nor tiny components overflow or vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centres(units: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of the sample."""
    rng = np.random.default_rng(SEED)
    c = units[rng.choice(len(units), min(n, len(units)), replace=False)]
    for _ in range(rounds):
        own = (units @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, units)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def usable(embedding: str = "embedding") -> Column:
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return e.isNotNull() & finite & F.exists(e, lambda x: x != 0)


class Lists:
    """What tasks need of a fitted index."""

    def __init__(self, sample: np.ndarray, n_lists: int) -> None:
        units = _unit(sample)
        self.turn = rotation(sample.shape[1])
        self.centres = centres(units, n_lists)
        self.sample = units
        self.sample_list = self.assign(units)
        n = len(self.centres)
        self.n_probed = min(n, max(8, math.ceil(PROBED * n)))

    def assign(self, units: np.ndarray) -> np.ndarray:
        return (units @ self.centres.T).argmax(axis=1)

    def probes(self, units: np.ndarray) -> np.ndarray:
        """Queries x lists, true where a query probes."""
        near = np.argpartition(-(units @ self.centres.T), self.n_probed - 1, axis=1)[:, : self.n_probed]
        out = np.zeros((len(units), len(self.centres)), bool)
        np.put_along_axis(out, near, True, axis=1)
        return out

    def bounds(self, units: np.ndarray, probed: np.ndarray, k: int) -> np.ndarray:
        """Squared distance of the k-th nearest sample vector in the probed lists."""
        out = np.full(len(units), np.inf)
        if len(self.sample) < k:
            return out
        for a in range(0, len(units), 256):
            near = np.where(probed[a : a + 256][:, self.sample_list], units[a : a + 256] @ self.sample.T, -np.inf)
            out[a : a + 256] = 2 - 2 * np.partition(near, -k, axis=1)[:, -k]
        return out + 1e-6


def scan(queries: np.ndarray, members: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, member) that no test drops; all vectors unit and turned."""
    d = queries.shape[1]
    seen = min(COLUMNS, d)
    q, c = queries[:, :seen], members[:, :seen]
    so_far = (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (q @ c.T)
    i, j = np.nonzero(so_far * (d / seen) <= _limit(bounds, seen, d)[:, None])
    so_far = so_far[i, j]
    while seen < d and len(i):
        upto = min(seen + COLUMNS, d)
        diff = queries[i, seen:upto] - members[j, seen:upto]
        so_far = so_far + np.einsum("ij,ij->i", diff, diff)
        seen = upto
        stay = so_far * (d / seen) <= _limit(bounds, seen, d)[i]
        i, j, so_far = i[stay], j[stay], so_far[stay]
    return i, j


def _limit(bounds: np.ndarray, seen: int, d: int) -> np.ndarray:
    return bounds * (1.0 if seen == d else (1.0 + EPSILON / math.sqrt(seen)) ** 2)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows, in double precision."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300) for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each query of (query, id, score) columns."""
    q, v, s = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return [x[rank < k] for x in (q, v, s)]


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(embedding)).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return spark.createDataFrame([], schema)
    rows = materialize(rows.where(F.size("v") == usual["d"]).withColumn("h", F.xxhash64("v")), "ann-rows")
    few = F.dense_rank().over(W.partitionBy("h", "v").orderBy("vec_id"))
    members = rows.select("h", "v", "vec_id").withColumn("r", few).where(F.col("r") <= k + 1).select("vec_id", "v").distinct()
    members = materialize(members, "ann-members")
    # Of the members, as the index has them: a repeated row would make the bound of the k-th nearest too tight.
    sample = [r.v for r in members.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").collect()]
    lists = Lists(np.array(sample, np.float64), min(MOST_LISTS, math.ceil(math.sqrt(usual["n"]))))
    index = spark.sparkContext.broadcast(lists)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = index.value.assign(_unit(_matrix(b.column("v"))))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *b.columns], names=["list", "vec_id", "v"])

    listed = members.mapInArrow(assigned, "list int, vec_id long, v array<double>")
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    listed = materialize(listed.repartition(parts(spark), "list", F.pmod(spread, F.lit(8))).sortWithinPartitions("list"), "ann-lists")

    wanted = rows.where("q").select("h", "v", "vec_id").distinct()
    reps = materialize(wanted.groupBy("h", "v").agg(F.min("vec_id").alias("rep")), "ann-queries")
    n_queries = reps.count()
    n_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    found = None
    for block in range(n_blocks):
        mine = reps.where(F.pmod(F.xxhash64("rep", F.lit(SEED)), F.lit(n_blocks)) == block).select("rep", "v").collect()
        if mine:
            part = _probe(listed, index, np.array([r.rep for r in mine]), np.array([r.v for r in mine], np.float64), k + 1)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = W.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    nearest = materialize(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("rep", "vec_id", "score"), "ann-nearest")
    named = wanted.join(reps, ["h", "v"]).select(F.col("vec_id").alias("query_id"), "rep")
    pairs = named.join(nearest, "rep").where("query_id != vec_id")
    rank = F.row_number().over(W.partitionBy("query_id", "rep").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probe(listed: DataFrame, index, ids: np.ndarray, originals: np.ndarray, k: int) -> DataFrame:
    """rep, vec_id, score: per task the k best of each query of a block."""
    block = listed.sparkSession.sparkContext.broadcast((ids, originals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, (ids, originals) = index.value, block.value
        kept: list[list[np.ndarray]] = []
        probed = bounds = turned = None
        for b in batches:
            if not b.num_rows:
                continue
            if probed is None:
                units = _unit(originals)
                probed, turned = lists.probes(units), (units @ lists.turn).astype(np.float32)
                bounds = lists.bounds(units, probed, k)
            own, vec_ids, v = b.column("list").to_numpy(), b.column("vec_id").to_numpy(), _matrix(b.column("v"))
            members = (_unit(v) @ lists.turn).astype(np.float32)
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for a, z in zip(starts, np.r_[starts[1:], len(own)]):
                for a in range(a, z, 2048):
                    some = np.flatnonzero(probed[:, own[a]])
                    i, j = scan(turned[some], members[a : min(z, a + 2048)], bounds[some])
                    if len(i):
                        kept.append([some[i], vec_ids[a + j], cosine(originals[some[i]], v[a + j])])
            if kept:
                kept = [_best(kept, k)]
                q, _, s = kept[0]
                # A query with k results here is bounded by the last of them.
                last = np.flatnonzero(np.bincount(q, minlength=len(ids))[q] == k)
                np.minimum.at(bounds, q[last], 2 - 2 * np.minimum.reduceat(s[last], np.arange(0, len(last), k)).repeat(k) + 1e-6 if len(last) else np.zeros(0))
        if kept:
            q, v, s = kept[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(s)], names=["rep", "vec_id", "score"])

    return listed.mapInArrow(run, "rep long, vec_id long, score double")
