"""Line dedup by an edit join over segments, in DataFrame operations only.

A line (without white space around it) goes if the same line stands earlier in the corpus, or if an earlier line is
within the allowed edits: one per ``CHARS_PER_EDIT`` characters of the shorter line, ``edits`` at most. Earlier is by
document id, then place; lines are judged on the input, not on what is left.

The join. A line with t edits allowed is split into t + 1 even segments. A line within t edits of it and no shorter
contains one of them unchanged, and near the same place: how near depends on the lengths (Li et al., 2011). So every line gives its segments to an index,
under its length, and looks up those of its own substrings that could be a segment of a line as long or up to t
shorter. Keys that two different lines share are few; they are found with an aggregate of
(key, smallest line hash, largest line hash), so no group of lines is gathered. Only lines with such
a key are joined, and the edit distance stands in the condition of a semi join: it asks
whether an earlier line is near, so families of near lines do not yield pairs.

The distance is Spark's built-in banded ``levenshtein`` with a threshold. Bit-parallel vectors
would have to be built from interpreted functions per character.

Defined results. Null or empty text: no lines. Blank lines are not counted and stay. Rows with equal ids are one
document (null ids too): their counts are added up, and equal lines at equal places are both first. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeflow.session import materialize

from .base import text_of

EDITS = 1
CHARS_PER_EDIT = 20
BLANKS = " \t\r\x0b\x0c"


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, place, line, size, h, g) of every line, null where it is blank; size is in bytes."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text_of(text), "\n")).alias("place", "raw"))
    line = whole.select("doc_id", "place", F.btrim("raw", F.lit(BLANKS)).alias("line"))
    named = line.withColumn("line", F.when(F.col("line") != "", F.col("line")))
    return named.withColumns({"size": F.octet_length("line"), "h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})


def allowed(n: Column, edits: int) -> Column:
    return F.least(F.floor(n / F.lit(CHARS_PER_EDIT)), F.lit(edits)).cast("int")


def _segment(n: Column, i: int, t: int) -> tuple[Column, Column]:
    """Start and length of segment i of t + 1 of a line of n characters; the last ones are longer."""
    short = F.floor(n / F.lit(t + 1)).cast("int")
    long_ones = F.pmod(n, F.lit(t + 1))
    before = F.greatest(F.lit(0), F.lit(i) - (F.lit(t + 1) - long_ones))
    return short * i + before, short + F.when(F.lit(i) >= F.lit(t + 1) - long_ones, 1).otherwise(0)


def substring_keys(line: Column, n: Column, edits: int) -> Column:
    """Array of (key, own): the line's own segments, and its substrings that a segment of an equal or shorter line may equal."""
    per_length = []
    for shorter in range(edits + 1):
        of = n - F.lit(shorter)
        choices = F.array().cast("array<struct<key:bigint,own:boolean>>")
        for t in range(max(1, shorter), edits + 1):
            keys = []
            for i in range(t + 1):
                start, size = _segment(of, i, t)
                for shift in range(max(-i, shorter - (t - i)), min(i, shorter + (t - i)) + 1):
                    key = F.xxhash64(F.lit(t), F.lit(i), of, F.substring(line, start + F.lit(shift + 1), size))
                    keys.append(F.struct(key.alias("key"), F.lit(shorter == 0 and shift == 0).alias("own")))
            choices = F.when(allowed(of, edits) == t, F.array(*keys)).otherwise(choices)
        per_length.append(choices)
    return F.concat(*per_length)


def _keyed(lines: DataFrame, edits: int) -> DataFrame:
    n = F.length("line")
    wide = lines.where(n >= CHARS_PER_EDIT).withColumn("k", F.explode(substring_keys(F.col("line"), n, edits)))
    return wide.select("*", F.col("k.key").alias("key"), F.col("k.own").alias("own")).drop("k")


def near_earlier(lines: DataFrame, firsts: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h, g) of the lines whose first place has a near line before it."""
    keyed = _keyed(lines.where("line IS NOT NULL"), edits)
    shared = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max("own").alias("own"))
    shared = materialize(shared.where("own AND a != b").select("key"), "line-keys")
    met = keyed.join(shared, "key").groupBy("key", "h", "g").agg(F.max("own").alias("own"), F.min("line").alias("line"))
    met = materialize(met.join(firsts, ["h", "g"]).select("key", "own", "h", "g", "line", "first"), "line-candidates")
    left, right = met.alias("l"), met.alias("r")

    def later(own_side: str) -> DataFrame:
        shorter, longer = (F.length("l.line"), F.length("r.line")) if own_side == "l" else (F.length("r.line"), F.length("l.line"))
        most = allowed(shorter, edits)
        near = F.lit(False)
        for t in range(1, edits + 1):
            near = near | ((most == t) & (F.levenshtein(F.col("l.line"), F.col("r.line"), t) >= 0))
        condition = (
            (F.col("l.key") == F.col("r.key")) & F.col(f"{own_side}.own") & (shorter <= longer)
            & (F.struct("r.first", "r.h", "r.g") < F.struct("l.first", "l.h", "l.g")) & near
        )
        return left.join(right, condition, "left_semi").select("h", "g")

    return later("l").unionByName(later("r")).distinct()


def judged(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """Every line with ``verdict``: kept, repeated (the same line is earlier) or near (a near line is); null line of documents without any."""
    lines = occurrences(docs)
    firsts = lines.where("line IS NOT NULL").groupBy("h", "g").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    firsts = materialize(firsts, "line-firsts")
    near = materialize(near_earlier(lines, firsts, edits), "line-near").withColumn("near", F.lit(True))
    known = firsts.join(near, ["h", "g"], "left")
    found = lines.join(known, ["h", "g"], "left")
    verdict = (
        F.when(F.col("size").isNull(), F.lit(None))
        .when(F.struct("doc_id", "place") != F.col("first"), F.lit("repeated"))
        .when(F.col("near"), F.lit("near"))
        .otherwise(F.lit("kept"))
    )
    return found.select("doc_id", "place", "line", "size", verdict.alias("verdict"))


def line_counts(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """Per document: doc_id, n_lines, n_repeated, n_near, kept_bytes (of kept lines)."""
    n = lambda v: F.coalesce(F.sum(F.when(F.col("verdict") == v, 1)), F.lit(0)).cast("bigint")
    rows = judged(docs, edits)
    # Sizes were taken where the lines are read, so that no line is shuffled here.
    size = F.when(F.col("verdict") == "kept", F.col("size")).otherwise(0)
    return rows.groupBy("doc_id").agg(
        F.count("verdict").alias("n_lines"), n("repeated").alias("n_repeated"), n("near").alias("n_near"), F.sum(size).cast("bigint").alias("kept_bytes")
    )


def cleaned(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, text) of each document with its kept lines only, in order. Needs distinct ids."""
    kept = judged(docs, edits).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("verdict") == "kept", F.struct("place", "line")))).alias("lines")
    )
    return kept.select("doc_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
