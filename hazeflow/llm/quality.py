"""Quality classifier: ordinal regression with cumulative links on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x). One weight vector over hashed text features is
shared by all grades; the thresholds are ordered. The expected grade and the tail
probabilities P(grade >= k) are what documents are selected by.

Fit on at most ``MOST_RATED`` rated documents, those with the smallest hash of their id. They are dealt into
``SLOTS`` fixed slots; each round every slot improves the common
parameters on its own documents, and the results are averaged (Zinkevich et al., 2010). One vector of
fixed length goes each way. Scoring reads every whole text once, without a shuffle.

Features: each distinct word, as it stands in lower case and without what surrounds its letters, and the document's shape
(shares of letters, symbols and upper case, word length, repetition), each in steps.

Defined results. Null or empty text: scored on its shape alone. Null grade or id: not learned from. Several grades of one id:
the lowest. No rated documents: every probability is null, and everything is kept. Null or repeated ids are scored like any other. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeflow.session import materialize

DIM = 1 << 17
MOST_RATED = 16_000
SLOTS = 4
ROUNDS = 2
STEPS = 60
#: Penalty on absolute weights: features that say nothing of the grade get none.
LASSO = 3e-4
#: A slot learns weights only of features that so many of its documents have.
MIN_DOCS = 5
RATE = 0.5
CACHE = 1_000_000
_SYMBOL, _UPPER = re.compile(r"[^\w\s]"), re.compile(r"[A-ZÀ-Þ]")
_INNER = re.compile(r"[^\W\d_](?:.*[^\W\d_])?", re.S)


def word_slot(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7) % DIM


def shape(text: str) -> list[str]:
    words, lines, n = text.split(), text.split("\n"), max(1, len(text))
    symbols = len(_SYMBOL.findall(text))
    shares = {
        "symbols": symbols / n, "upper": len(_UPPER.findall(text)) / n,
        "distinct": len(set(words)) / max(1, len(words)), "lines": len(set(lines)) / len(lines),
    }
    return [f"\t{k} {int(20 * v)}" for k, v in shares.items()] + [
        f"\tlength {min(20, int(2 * (n - symbols) / max(1, len(words))))}", f"\twords {len(words).bit_length()}"
    ]


def features(text: str | None) -> set[str]:
    """Distinct features; shape features begin with a tab, which no word does."""
    text = text or ""
    words = set(text.lower().split())
    inner = {m.group() for w in words if not w.isalpha() and (m := _INNER.search(w))}
    return words | inner | set(shape(text))


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = slot = word_slot(word)
        return slot


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, and positive steps."""
    return np.concatenate((raw[:1], raw[0] + np.cumsum(np.exp(np.clip(raw[1:], -20, 20)))))


def tails(score: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ... as columns."""
    return 1.0 - _sigmoid(thresholds(raw)[None, :] - score[:, None])


def local_fit(weights: np.ndarray, raw: np.ndarray, docs: list[np.ndarray], grades: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximal adaptive steps (Duchi et al., 2011) on all given documents, from the given parameters. A document's features weigh 1 / sqrt(log2 of their number)."""
    frequent = np.bincount(np.concatenate(docs), minlength=len(weights)) >= MIN_DOCS
    docs = [d[frequent[d]] for d in docs]
    counts = np.array([len(d) for d in docs])
    of, index = np.repeat(np.arange(len(docs)), counts), np.concatenate(docs)
    scale = 1.0 / np.sqrt(np.log2(2 + counts))
    n_levels = len(raw)
    p = np.concatenate((weights, raw)).astype(np.float64)
    power = np.zeros_like(p)
    for _ in range(steps):
        w, r = p[:-n_levels], p[-n_levels:]
        score = np.bincount(of, w[index], len(docs)) * scale
        cuts = np.concatenate(([-np.inf], thresholds(r), [np.inf]))
        upper, lower = _sigmoid(cuts[grades + 1] - score), _sigmoid(cuts[grades] - score)
        upper[grades == n_levels], lower[grades == 0] = 1.0, 0.0
        prob = np.maximum(upper - lower, 1e-9)
        by_score = (1.0 - upper - lower) * scale / len(docs)
        grad_w = np.bincount(index, by_score[of], len(w))
        by_cut = np.zeros(n_levels)
        for k in range(n_levels):
            by_cut[k] = -((upper * (1 - upper) / prob)[grades == k].sum() - (lower * (1 - lower) / prob)[grades == k + 1].sum()) / len(docs)
        grad_r = np.array([by_cut[k:].sum() * (1.0 if k == 0 else np.exp(np.clip(r[k], -20, 20))) for k in range(n_levels)])
        g = np.concatenate((grad_w, grad_r))
        power += g * g
        pace = RATE / (np.sqrt(power) + 1e-4)
        p -= pace * g
        w = p[:-n_levels]
        np.copyto(w, np.sign(w) * np.maximum(np.abs(w) - LASSO * pace[:-n_levels], 0.0))
    return p[:-n_levels], p[-n_levels:]


def fit(docs: DataFrame, grades: DataFrame, n_grades: int, most: int = MOST_RATED) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and raw thresholds from (doc_id, grade); grades 0 to n_grades - 1. None if nothing is rated."""
    spark = docs.sparkSession
    rated = grades.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    # At most ``most`` rows, hence the broadcast.
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_rated"), "grade")
    wide = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_rated"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for b in batches:
            rows = [np.unique(np.fromiter(map(slots.__getitem__, features(t.as_py())), np.int32)).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(rows, pa.binary())], names=["doc_id", "grade", "x"])

    rows = wide.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("grade").cast("int").alias("grade"), "text").mapInArrow(hashed, "doc_id long, grade int, x binary")
    rows = materialize(rows.withColumn("slot", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SLOTS))), "quality-sample")
    weights, raw = np.zeros(DIM), np.concatenate(([-1.0], np.zeros(n_grades - 2)))
    for _ in range(ROUNDS):
        common = spark.sparkContext.broadcast((weights.astype(np.float32), raw))

        def step(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["doc_id", "grade", "x"])
            w, r = local_fit(*common.value, [np.frombuffer(x, np.int32) for x in group["x"]], group["grade"].to_numpy(), STEPS)
            return pd.DataFrame({"slot": [group["slot"].iloc[0]], "n": [len(group)], "w": [w.astype(np.float32).tobytes()], "r": [r.tobytes()]})

        found = sorted(rows.groupBy("slot").applyInPandas(step, "slot long, n long, w binary, r binary").collect(), key=lambda r: r.slot)
        if not found:
            return None
        share = np.array([r.n for r in found], float) / sum(r.n for r in found)
        weights = sum(s * np.frombuffer(r.w, np.float32).astype(float) for s, r in zip(share, found))
        raw = sum(s * np.frombuffer(r.r) for s, r in zip(share, found))
    return weights, raw


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, n_grades: int) -> DataFrame:
    """doc_id, expected_grade, p_ge_1, p_ge_2, ... of every row."""
    names = ["doc_id", "expected_grade", *(f"p_ge_{k}" for k in range(1, n_grades))]
    types = ", ".join(f"{n} {'long' if n == 'doc_id' else 'double'}" for n in names)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    if model is None:
        return rows.select("doc_id", *[F.lit(None).cast("double").alias(n) for n in names[1:]])
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, raw = shared.value
        slots = _Slots()
        for b in batches:
            scores = np.zeros(b.num_rows)
            for i, t in enumerate(b.column("text")):
                index = np.unique(np.fromiter(map(slots.__getitem__, features(t.as_py())), np.int32))
                scores[i] = weights[index].sum(dtype=float) / np.sqrt(np.log2(2 + len(index)))
            tail = tails(scores, raw)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tail.sum(axis=1)), *map(pa.array, tail.T)], names=names)

    return rows.mapInArrow(run, types)
