"""Mixing sources to target weights by exponential keys (Efraimidis and Spirakis, 2006).

Every source gets a target in words. What a source has less than its target is
repeated: complete epochs of all its documents first, and the rest from a weighted sample
without replacement. A document's key is -ln(u) / quality with u from a hash of its id; the
documents of a source in ascending key order are such a sample, and they
are taken while the running word count comes nearer to the rest.

Scale: nothing but narrow rows (id, source, size, key) is shuffled. A source is
cut into key ranges of some thousand rows, whose sums are aggregated before the shuffle; only
the range in which a source's rest ends is put in order. What comes back is one cutoff per source.

Defined results. Null text: size 0. Null source: a source of its own, last in order.
Null id: hashed as the text "null". Rows with the same source, id, size and quality are taken together.
Missing, null, negative or zero quality: 1. A source of size 0 has target 0.
Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazeflow.session import materialize

from .base import n_words

#: Rows of a source that one key range holds on average.
RANGE_ROWS = 1000


def sampling_key(doc_id: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality, u from the first 52 bits of md5(seed:id), above 0 and at most 1."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("bigint")
    u = (bits + F.lit(1)).cast("double") / F.lit(float(1 << 52))
    return -F.log(u) / quality


def source_targets(sources: DataFrame, ratios: list[float], cap: float) -> DataFrame:
    """Targets of (source, source_size) rows: shares of all words by ratio, at most ``cap`` times a source's size.

    What is cut off is reshared by ratio until no source is above its limit. That
    is the level at which the sum of min(cap * size, level * ratio) is the sum of all
    sizes, and is read off running sums over the sources in order of cap * size / ratio.
    The windows run over one row per source.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    ratio = F.element_at(F.array(*[F.lit(float(r)) for r in ratios]), F.pmod(F.row_number().over(every) - 1, len(ratios)) + 1)
    ranked = sources.withColumn("ratio", ratio).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_limit = W.orderBy(F.col("most") / F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("ratio").over(whole) - F.coalesce(F.sum("ratio").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level).withColumn(
        "fits", F.when(F.col("level") <= F.col("most") / F.col("ratio"), F.col("level"))
    )
    # The first level that fits is the highest: from there on, each source taken as full lowers it.
    target = F.least("most", F.max("fits").over(whole) * F.col("ratio"))
    return levels.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words().alias("size"))


def keyed(rows: DataFrame, quality: DataFrame | None, seed: int) -> DataFrame:
    """``rows`` with doc_id joined to (doc_id, quality), one row per id at most, and given their sampling keys."""
    if quality is None:
        return rows.withColumn("key", sampling_key(F.col("doc_id"), F.lit(1.0), seed))
    q = quality.select(F.col("doc_id").alias("_q"), F.when(F.col("quality") > 0, F.col("quality").cast("double")).alias("_quality"))
    joined = rows.join(q, rows["doc_id"] == q["_q"], "left")
    return joined.withColumn("key", sampling_key(F.col("doc_id"), F.coalesce("_quality", F.lit(1.0)), seed)).drop("_q", "_quality")


def cutoffs(rows: DataFrame, ratios: list[float], cap: float) -> DataFrame:
    """Per source: source_size, target, complete epochs, and the last (key, doc_id, size) of the fractional part, if any."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sums = materialize(sums, "mix-sources")
    targets = source_targets(sums.drop("n"), ratios, cap)
    plan = sums.drop("source_size").withColumnRenamed("source", "_s").join(
        targets, F.col("_s").eqNullSafe(F.col("source"))
    ).drop("_s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = plan.withColumn("epochs", epochs).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    ).withColumn("ranges", F.ceil(F.col("n") / F.lit(RANGE_ROWS)).cast("bigint"))
    plan = materialize(plan.drop("n"), "mix-plan")

    at = plan.select(F.col("source").alias("_s"), "rest", "ranges")
    placed = rows.join(at, rows["source"].eqNullSafe(at["_s"])).drop("_s").withColumn(
        # Rises with the key, so ranges are in key order.
        "range", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("ranges")), F.col("ranges") - 1).cast("bigint")
    )
    ranges = placed.groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("range"))
    # Where a source's rest ends: the first range that reaches it.
    reached = ranges.withColumn("before", upto - F.col("words")).where(
        (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))
    )
    ending = reached.groupBy("source").agg(F.min(F.struct("range", "before", "rest")).alias("e")).select(
        F.col("source").alias("_s"), F.col("e.range").alias("_range"), F.col("e.before").alias("before")
    )
    inside = placed.join(
        ending, placed["source"].eqNullSafe(ending["_s"]) & (placed["range"] == ending["_range"])
    ).drop("_s", "_range")
    order = W.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    running = F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
    nearer = (F.col("upto") + F.col("upto") - F.col("size")) <= F.lit(2.0) * F.col("rest")
    last = inside.withColumn("upto", running).where(nearer).groupBy("source").agg(
        F.max(F.struct("key", "doc_id", "size")).alias("last")
    ).select(F.col("source").alias("_s"), F.col("last"))
    # No document of the ending range taken: everything below the range still is.
    edge = plan.join(ending.withColumnRenamed("_s", "_e"), F.col("source").eqNullSafe(F.col("_e")), "left").drop("_e", "before")
    edge = edge.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return materialize(edge.withColumnRenamed("_range", "last_range"), "mix-cutoffs")


def copies(edge: DataFrame) -> Column:
    """How often a row joined to its source's cutoff is taken."""
    here = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.col("ranges")), F.col("ranges") - 1)
    # asc_nulls_first order of the fields, as structs compare.
    within = F.coalesce(F.struct("key", "doc_id", "size") <= F.col("last"), F.lit(False))
    part = F.when(F.col("last_range").isNull() | (F.col("rest") <= 0), F.lit(0)).when(
        (here < F.col("last_range")) | within, F.lit(1)
    ).otherwise(F.lit(0))
    return (F.col("epochs") + part).cast("bigint")


def _decided(rows: DataFrame, edge: DataFrame) -> DataFrame:
    e = edge.withColumnRenamed("source", "_s")
    return rows.join(e, rows["source"].eqNullSafe(e["_s"])).withColumn("copies", copies(e))


def mix(docs: DataFrame, quality: DataFrame | None = None, ratios=(1.0, 2.0, 3.0), cap: float = 3.0, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words, repeats counted).

    ``quality``: (doc_id, quality), one row per id.
    """
    rows = materialize(keyed(sized(docs), quality, seed), "mix-rows")
    return _decided(rows, cutoffs(rows, list(ratios), cap)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, ratios=(1.0, 2.0, 3.0), cap: float = 3.0, seed: int = 42) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as in ``docs``."""
    edge = cutoffs(materialize(keyed(sized(docs), quality, seed), "mix-rows"), list(ratios), cap)
    wide = docs.select(
        F.struct("*").alias("_doc"), "doc_id", "source", n_words().alias("size")
    )
    taken = _decided(keyed(wide, quality, seed), edge).where(F.col("copies") > 0)
    return taken.select("_doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_c")).select("_doc.*")


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): 2 where some label calls the document good, 0.5 where all that say anything call it bad."""
    best = labels.groupBy("doc_id").agg(F.max("quality").alias("best"))
    return best.select("doc_id", F.when(F.col("best") > 0, F.lit(2.0)).when(F.col("best") == 0, F.lit(0.5)).alias("quality"))
