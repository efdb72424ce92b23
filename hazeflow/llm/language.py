"""Language ID by a linear-chain conditional random field over words.

Every word gets a label; a document's language is the one with the largest mean
marginal over its words, and the score is that mean. Word features are affixes, character n-grams, the word itself
and its membership in each language's lexicon; transitions are learned. Marginals come from
forward-backward, so a text that switches languages is labelled in spans.

Fit on a bounded sample: about ``MOST_LABELLED`` documents per language, chosen by a hash of their id, and of each at most ``SAMPLE_WORDS`` words, in even
stretches from its first word to its last. Of more than ``MOST_LABELS`` languages the most frequent are learned, which bounds the model; both are parameters of
``fit``. Sampled documents are dealt into
``SLOTS`` fixed slots. A slot makes code-switched sequences from its documents (stretches of words
of one language after another), so that staying and switching are both seen, and improves the common parameters;
the slots' results are averaged each round. Lexicons hold the most frequent words of the same sample that
one language has nearly to itself.

Tagging reads every whole text once, without a shuffle. Forward-backward runs on blocks of
``BLOCK`` words at once: the product of a block's transition matrices links the blocks of a document exactly.

Defined results. Null text, or none with a letter: "und", score 0. Null language or id: not learned from. No labelled
document: everything is "und". Repeated rows each return. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazeflow.session import materialize

DIM = 1 << 15
MOST_LABELLED = 1500
MOST_LABELS = 500
#: Words of a labelled document that sequences are cut from, in stretches spread over the whole text.
SAMPLE_WORDS = 400
LEXICON = 300
SLOTS = 4
ROUNDS = 2
STEPS = 40
SEQUENCES, SEQUENCE_WORDS, STRETCH = 1000, 60, 10
RIDGE = 1e-4
RATE = 0.1
BLOCK = 32
#: Characters tagged at once, and new words weighed at once: they bound a task's memory beside the words it keeps.
SLICE_CHARS = 600_000
EMIT_WORDS = 1 << 14
CACHE = 200_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters. The pattern also takes numerals that are neither digits nor letters (fractions, circled ones); these part words."""
    words = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [w for x in words for w in "".join(c if c.isalpha() else " " for c in x).split()]


def spread(words: list[str], most: int = SAMPLE_WORDS) -> list[str]:
    """At most ``most`` of the words: stretches of ``STRETCH`` at even distances, the first at the start, the last at the end."""
    if len(words) <= most:
        return words
    starts = np.linspace(0, len(words) - STRETCH, most // STRETCH).astype(int)
    return [w for a in starts.tolist() for w in words[a : a + STRETCH]]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(DIM)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) pairs in order of words: n-grams with word ends marked, affixes of three, the word."""
    text = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(first + sizes, sizes) - np.arange(len(text))
    start = np.zeros(len(text), bool)
    start[first] = True
    prime, found = np.uint64(0x100000001B3), []
    h = text.copy()
    for n in range(2, 5):
        h[: len(text) - n + 1] = h[: len(text) - n + 1] * prime + text[n - 1 :]
        # Of the 4-grams only those at a word's end: affixes of three letters.
        inside = (left >= n) if n < 4 else (left >= n) & (start | (left == n))
        at = np.flatnonzero(inside)
        found.append((of[at], _mixed(h[at] + np.uint64(n))))
    whole = np.zeros(len(words), np.uint64)
    for k in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > k)
        whole[has] = whole[has] * prime + text[first[has] + k]
    found.append((np.arange(len(words)), _mixed(whole + np.uint64(9))))
    word, feature = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(word, kind="stable")
    return word[order], feature[order]


@dataclass
class Model:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # DIM x labels
    of_lexicon: np.ndarray  # labels (and none) x labels
    moves: np.ndarray  # log transition weights

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log weights of the labels of each word."""
        if not words:
            return np.zeros((0, len(self.labels)))
        word, feature = word_features(words)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        n = np.diff(np.r_[first, len(word)])
        out = np.add.reduceat(self.weights[feature], first, axis=0) / np.sqrt(n)[:, None]
        member = np.fromiter((self.lexicon.get(w, len(self.labels)) for w in words), np.int64, len(words))
        return out + self.of_lexicon[member]


def _steps(moves: np.ndarray) -> np.ndarray:
    """Transition factors of the words, scaled; the chain starts from equal weights."""
    return np.exp(moves - moves.max())


def marginals(log_weights: np.ndarray, doc_words: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label marginals of all words. ``doc_words``: words of each chain, each above 0."""
    n_labels, move = log_weights.shape[1], _steps(moves)
    blocks = -(-doc_words // BLOCK)
    first_block, first_word = np.cumsum(blocks) - blocks, np.cumsum(doc_words) - doc_words
    total = int(blocks.sum())
    place = np.arange(len(log_weights)) + np.repeat(first_block * BLOCK - first_word, doc_words)
    weight = np.zeros((total * BLOCK, n_labels))
    weight[place] = np.exp(log_weights - log_weights.max(axis=1, keepdims=True)) + 1e-30
    weight = weight.reshape(total, BLOCK, n_labels)
    size = np.full(total, BLOCK)
    size[first_block + blocks - 1] = doc_words - (blocks - 1) * BLOCK

    product = np.broadcast_to(np.eye(n_labels), (total, n_labels, n_labels)).copy()
    for t in range(BLOCK):
        live = size > t
        stepped = (product.reshape(-1, n_labels) @ move).reshape(product.shape) * weight[:, t, None, :]
        stepped /= stepped.max(axis=(1, 2), keepdims=True) + 1e-300
        product = np.where(live[:, None, None], stepped, product)

    # Along each document, block by block; long documents last.
    into, out_of = np.full((total, n_labels), 1.0 / n_labels), np.full((total, n_labels), 1.0 / n_labels)
    order = np.argsort(-blocks, kind="stable")
    longest, ascending = int(blocks.max(initial=0)), np.sort(blocks)
    for k in range(1, longest):
        at = first_block[order[: len(blocks) - np.searchsorted(ascending, k, "right")]] + k
        v = np.einsum("di,dij->dj", into[at - 1], product[at - 1])
        into[at] = v / v.sum(axis=1, keepdims=True)
    for k in range(1, longest):
        some = order[: len(blocks) - np.searchsorted(ascending, k, "right")]
        at = first_block[some] + blocks[some] - 1 - k
        v = np.einsum("dij,dj->di", product[at + 1], out_of[at + 1])
        out_of[at] = v / v.sum(axis=1, keepdims=True)

    ahead = np.empty((BLOCK, total, n_labels))
    a = into
    for t in range(BLOCK):
        a = np.where((size > t)[:, None], (a @ move) * weight[:, t], a)
        a = a / a.sum(axis=1, keepdims=True)
        ahead[t] = a
    b = out_of
    for t in range(BLOCK - 1, -1, -1):
        ahead[t] *= b
        b = np.where((size > t)[:, None], (b * weight[:, t]) @ move.T, b)
        b = b / b.sum(axis=1, keepdims=True)
    found = ahead.transpose(1, 0, 2).reshape(-1, n_labels)[place]
    return found / found.sum(axis=1, keepdims=True)


# --- learning ---


def code_switched(docs: list[tuple[int, list[str]]], rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Sequences of SEQUENCE_WORDS words and their labels, stretch by stretch from a language drawn at random."""
    by_label: dict[int, list[list[str]]] = {}
    for label, words in docs:
        by_label.setdefault(label, []).append(words)
    labels, sequences, gold = sorted(by_label), [], []
    for _ in range(SEQUENCES):
        words, marks = [], []
        while len(words) < SEQUENCE_WORDS:
            label = labels[rng.integers(len(labels))]
            own = by_label[label][rng.integers(len(by_label[label]))]
            n = min(int(rng.geometric(1 / STRETCH)), SEQUENCE_WORDS - len(words))
            at = int(rng.integers(max(1, len(own) - n + 1)))
            words += own[at : at + n]
            marks += [label] * len(own[at : at + n])
        sequences.append(words)
        gold.append(marks)
    return sequences, np.array(gold)


def local_fit(model: Model, sequences: list[list[str]], gold: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adam on the conditional log-likelihood of the sequences, all of one length."""
    n_seq, n_words = gold.shape
    n_labels = len(model.labels)
    distinct = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
    vocabulary = list(distinct)
    at = np.array([[distinct[w] for w in s] for s in sequences])
    word, feature = word_features(vocabulary)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    scale = 1.0 / np.sqrt(np.diff(np.r_[first, len(word)]))
    member = np.array([model.lexicon.get(w, n_labels) for w in vocabulary])
    shapes = [model.weights.shape, model.of_lexicon.shape, model.moves.shape]
    cut = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    p = np.concatenate([x.ravel() for x in (model.weights, model.of_lexicon, model.moves)]).astype(np.float64)
    m, v = np.zeros_like(p), np.zeros_like(p)
    one = np.eye(n_labels)
    seen_moves = np.zeros((n_labels, n_labels))
    np.add.at(seen_moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1.0)
    for t in range(1, steps + 1):
        weights, of_lexicon, moves = (x.reshape(s) for x, s in zip(np.split(p, cut), shapes))
        log_w = (np.add.reduceat(weights[feature], first, axis=0) * scale[:, None] + of_lexicon[member])[at]
        e, move = np.exp(log_w - log_w.max(axis=2, keepdims=True)) + 1e-30, _steps(moves)
        ahead, behind = np.empty_like(e), np.empty_like(e)
        a = np.full((n_seq, n_labels), 1.0 / n_labels)
        for k in range(n_words):
            a = (a @ move) * e[:, k]
            a /= a.sum(axis=1, keepdims=True)
            ahead[:, k] = a
        b = np.full((n_seq, n_labels), 1.0 / n_labels)
        for k in range(n_words - 1, -1, -1):
            behind[:, k] = b
            b = (b * e[:, k]) @ move.T
            b /= b.sum(axis=1, keepdims=True)
        marginal = ahead * behind
        marginal /= marginal.sum(axis=2, keepdims=True)
        pair = ahead[:, :-1, :, None] * move * (e[:, 1:] * behind[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        # The start is a step from equal weights too.
        begin = np.full(n_labels, 1.0 / n_labels)[None, :, None] * move * (e[:, 0] * behind[:, 0])[:, None, :]
        begin /= begin.sum(axis=(1, 2), keepdims=True)
        given = move / move.sum(axis=0, keepdims=True)
        n = gold.size
        by_word = np.zeros((len(vocabulary), n_labels))
        error = (marginal - one[gold]).reshape(-1, n_labels)
        for k in range(n_labels):
            by_word[:, k] = np.bincount(at.ravel(), error[:, k], len(vocabulary)) / n
        spread = (by_word * scale[:, None])[word]
        grad_w = np.stack([np.bincount(feature, spread[:, k], DIM) for k in range(n_labels)], axis=1)
        grad_l = np.zeros_like(of_lexicon)
        np.add.at(grad_l, member, by_word)
        want = seen_moves.copy()
        for k in range(n_labels):
            want[:, k] += given[:, k] * np.count_nonzero(gold[:, 0] == k)
        grad_m = (pair.sum(axis=(0, 1)) + begin.sum(axis=0) - want) / n
        g = np.concatenate([grad_w.ravel(), grad_l.ravel(), grad_m.ravel()]) + RIDGE * p / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return tuple(x.reshape(s) for x, s in zip(np.split(p, cut), shapes))


def fit(docs: DataFrame, usable: Column, most: int = MOST_LABELLED, most_labels: int = MOST_LABELS) -> Model | None:
    """A model from the rows of (doc_id, text, lang) for which ``usable`` holds; None if no text is labelled.

    It is fitted on ``most`` documents per language on average, and knows the ``most_labels`` most frequent languages, ties by name.
    """
    spark = docs.sparkSession
    rows = docs.where(usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_labels).collect()
    if not counts:
        return None
    labels = sorted(r.lang for r in counts)
    # A share of each language by hash: ``most`` on average, nothing counted or ranked across tasks.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, most / r.n))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.select("doc_id", "text", "lang", F.element_at(share, F.col("lang")).alias("share")).where(chance < F.col("share"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [spread(words_of(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "lang", "words"])

    sample = sample.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").mapInArrow(cut, "doc_id long, lang string, words array<string>")
    slot = F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SLOTS)).alias("slot")
    sample = materialize(sample.where(F.size("words") > 0).select("doc_id", "lang", "words", slot), "language-sample")
    seen = sample.select("lang", F.explode("words").alias("word")).groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))
    alone = seen.groupBy("word").agg(F.max(F.struct("n", "lang")).alias("best"), F.sum("n").alias("all")).where(F.col("best.n") >= 0.9 * F.col("all"))
    top = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    frequent = alone.select("word", F.col("best.lang").alias("lang"), F.col("best.n").alias("n")).withColumn("r", F.row_number().over(top)).where(F.col("r") <= LEXICON)
    number = {x: i for i, x in enumerate(labels)}
    lexicon = {r.word: number[r.lang] for r in frequent.collect()}
    n = len(labels)
    model = Model(labels, lexicon, np.zeros((DIM, n)), np.zeros((n + 1, n)), np.zeros((n, n)))
    for _ in range(ROUNDS):
        common = spark.sparkContext.broadcast(model)

        def step(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("doc_id", kind="stable")
            own = common.value
            docs = [(number[x], list(w)) for x, w in zip(group["lang"], group["words"])]
            sequences, gold = code_switched(docs, np.random.default_rng(int(group["slot"].iloc[0])))
            found = local_fit(own, sequences, gold, STEPS)
            return pd.DataFrame({"slot": [group["slot"].iloc[0]], "p": [np.concatenate([x.ravel() for x in found]).astype(np.float32).tobytes()]})

        fitted = sorted(sample.groupBy("slot").applyInPandas(step, "slot long, p binary").collect(), key=lambda r: r.slot)
        if not fitted:
            return None
        p = np.mean([np.frombuffer(r.p, np.float32).astype(float) for r in fitted], axis=0)
        w, lx, mv = np.split(p, [DIM * n, DIM * n + (n + 1) * n])
        model = Model(labels, lexicon, w.reshape(DIM, n), lx.reshape(n + 1, n), mv.reshape(n, n))
    return model


# --- tagging ---


class _Words(dict):
    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.waiting.append(word)
        return number


class Tagger:
    """Word marginals of texts; emissions of distinct words are kept while the task runs, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.words, self.known = _Words(), np.zeros((0, len(self.model.labels)))

    def tag(self, texts: list[str | None]) -> list[np.ndarray]:
        """A (words x labels) array per text."""
        if len(self.words) > CACHE:
            self._clear()
        lists = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        numbers = np.fromiter((n for ws in lists for n in map(self.words.__getitem__, ws)), np.int64, int(counts.sum()))
        if new := self.words.waiting:
            self.known = np.concatenate([self.known, *[self.model.emissions(new[a : a + EMIT_WORDS]) for a in range(0, len(new), EMIT_WORDS)]])
            self.words.waiting = []
        if not len(numbers):
            return [np.zeros((0, len(self.model.labels)))] * len(texts)
        found = marginals(self.known[numbers], counts[counts > 0], self.model.moves)
        return np.split(found, np.cumsum(counts)[:-1])


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in stretches of about SLICE_CHARS, one at a time as Python strings."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    a, chars = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if chars > SLICE_CHARS:
            yield texts[a:i].to_pylist()
            a, chars = i, 0
        chars += n
    if a < len(texts):
        yield texts[a:].to_pylist()


def _predicted(tagger: Tagger | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    labels, scores = [], []
    for some in _slices(texts):
        for m in tagger.tag(some) if tagger else [()] * len(some):
            mean = m.mean(axis=0) if len(m) else None
            best = UNKNOWN if mean is None else tagger.model.labels[int(mean.argmax())]
            labels.append(best)
            scores.append(0.0 if mean is None else min(1.0, float(mean.max())))
    return labels, scores


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value else None
        for b in batches:
            labels, scores = _predicted(tagger, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the text's stretches of one language: (first word, number of words, language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in batches:
            rows = []
            for some in _slices(b.column("text")):
                for m in tagger.tag(some):
                    best = m.argmax(axis=1)
                    at = np.flatnonzero(np.r_[True, best[1:] != best[:-1]][: len(best)])
                    n = np.diff(np.r_[at, len(best)])
                    rows.append([{"start": int(i), "n": int(k), "lang": tagger.model.labels[best[i]]} for i, k in zip(at, n)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<start:int,n:int,lang:string>>"
    )


def recognised(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is unknown or scored below ``least``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value else None
        for b in batches:
            labels, scores = _predicted(tagger, b.column(at))
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(labels, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
