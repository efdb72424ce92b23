"""Byte-level BPE encoding and decoding with forced-boundary splitting.

Merging joins two neighbouring byte strings only into a vocabulary token. Where two bytes that occur side by side in no token
meet in a text, no merge can ever cross, whatever surrounds them: the place is a certain cut. The fragments between cuts are
encoded independently, each distinct one once per Python worker, and their ids are concatenated.

The tokenizer first splits a text by a pattern, and a cut must not change how the rest is split. The pattern looks ahead only
behind white space, and contractions begin with an apostrophe; so a cut is taken only between whole characters, behind one that is no
white space, and not before an apostrophe. Pairs inside added tokens (``<|endoftext|>``) count as occurring, so these stay whole.

The vocabulary file is read by the driver and sent to the tasks (a few megabytes, fixed by the vocabulary). Nothing is shuffled: a row is encoded
where it is read. Fragments are kept up to a bound on their bytes; a text goes through whole, its batch in slices.

Defined results. Null or empty text: no ids, and the empty text decoded. Null ids of documents, repeated rows and extra columns: every row returns,
with its doc_id. Bytes that are no UTF-8 count as U+FFFD. Decoding skips ids outside the vocabulary; bytes that form no character become U+FFFD. Empty table: no rows.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fragments a worker keeps, their bytes, and bytes of text it takes at a time.
CACHE_FRAGMENTS = 250_000
CACHE_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
#: The library's results are large objects: so many exist at a time.
ENCODED_AT_ONCE = 4096

# Last bytes of the white space characters beyond ASCII, with the lead bytes they go with.
_SPACE_ENDS = [*range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
_SPACE_LEADS_2 = [0xC2]
_SPACE_LEADS_3 = [0xE1, 0xE2, 0xE3]


def byte_of_character() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


def token_bytes(vocabulary: str) -> dict[int, bytes]:
    """Bytes of every id of a tokenizer's JSON, added tokens included."""
    described, of = json.loads(vocabulary), byte_of_character()
    named = {**{i: t for t, i in described["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in described["added_tokens"]}}
    return {i: bytes(map(of.__getitem__, t)) if all(c in of for c in t) else t.encode() for i, t in named.items()}


def certain_cuts(tokens: list[bytes]) -> np.ndarray:
    """For every two bytes, whether they stand side by side in no token and a cut between them keeps the tokenizer's own splitting.

    White space beyond ASCII on the left is left to ``cut_places``: it shows in more than one byte.
    """
    cut = np.ones(1 << 16, bool)
    for t in tokens:
        b = np.frombuffer(t, np.uint8).astype(np.uint16)
        cut[(b[:-1] << 8) | b[1:]] = False
    cut = cut.reshape(256, 256)
    cut[: ord(" ") + 1] = False  # behind white space and control characters
    cut[0xC0:] = False  # within a character
    cut[:, 0x80:0xC0] = False
    cut[:, ord("'")] = False
    return cut.ravel()


def cut_places(text: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Positions of the certain cuts in a text's bytes."""
    if len(text) < 2:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(cuts[(text[:-1].astype(np.uint16) << 8) | text[1:]]) + 1
    wide = at[text[at - 1] >= 0x80]
    wide = wide[np.isin(text[wide - 1], _SPACE_ENDS)]
    space = np.isin(text[np.maximum(wide - 2, 0)], _SPACE_LEADS_2) | np.isin(text[np.maximum(wide - 3, 0)], _SPACE_LEADS_3)
    return np.setdiff1d(at, wide[space], assume_unique=True) if space.any() else at


class _Fragments(dict):
    """Fragment -> number; a new one gets the next number and waits to be encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[bytes] = []

    def __missing__(self, fragment: bytes) -> int:
        self[fragment] = number = len(self)
        self.waiting.append(fragment)
        return number


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after the other."""
    upto = np.cumsum(sizes)
    return flat[np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]


class Encoder:
    """Encodes texts with a byte-level vocabulary, by fragments."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts = certain_cuts(list(token_bytes(vocabulary).values()))
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.held = _Fragments(), 0
        self.flat, self.starts, self.sizes = array("i"), array("q"), array("q")

    def _settle(self) -> None:
        waiting, self.numbers.waiting = self.numbers.waiting, []
        for a in range(0, len(waiting), ENCODED_AT_ONCE):
            few = [w.decode("utf-8", "replace") for w in waiting[a : a + ENCODED_AT_ONCE]]
            for ids in (e.ids for e in self.tokenizer.encode_batch_fast(few, add_special_tokens=False)):
                self.starts.append(len(self.flat))
                self.sizes.append(len(ids))
                self.flat.extend(ids)
        self.held += sum(map(len, waiting))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if self.held > CACHE_BYTES or len(self.numbers) > CACHE_FRAGMENTS:
            self._clear()
        numbers, n_fragments = array("q"), np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                at = cut_places(np.frombuffer(text, np.uint8), self.cuts).tolist()
                numbers.extend([self.numbers[text[a:b]] for a, b in zip([0, *at], [*at, len(text)])])
                n_fragments[k] = len(at) + 1
        if self.numbers.waiting:
            self._settle()
        of = np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)
        starts, sizes = (np.array(x, np.int64)[of] for x in (self.starts, self.sizes))
        ids = gathered(np.array(self.flat, np.int32), starts, sizes)
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(n_fragments)))]
        return ids, np.diff(upto)


class Decoder:
    """Texts of ids: the bytes of the tokens, read as UTF-8."""

    def __init__(self, vocabulary: str) -> None:
        known = token_bytes(vocabulary)
        n = max(known) + 1
        self.sizes = np.array([len(known.get(i, b"")) for i in range(n)] + [0], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(known.get(i, b"") for i in range(n)), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        none = len(self.sizes) - 1
        of = np.where((ids >= 0) & (ids < none), ids, none)
        return gathered(self.flat, self.starts[of], self.sizes[of]).tobytes().decode("utf-8", "replace")


_READY: dict[tuple[type, str], Encoder | Decoder] = {}


def _ready(kind: type, vocabulary: str):
    """One per Python worker, so that tasks that follow one another share it."""
    if (kind, vocabulary) not in _READY:
        _READY[kind, vocabulary] = kind(vocabulary)
    return _READY[kind, vocabulary]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    a = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def _read(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row, as the tokenizer of the JSON file at ``path`` encodes its text."""
    vocabulary = _read(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ready(Encoder, vocabulary.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices([len(t or b"") for t in texts]):
                ids, counts = encoder.encode(texts[a:b])
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text of every row of (doc_id, ids)."""
    vocabulary = _read(tokens, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _ready(Decoder, vocabulary.value)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()
            for a, b in _slices([4 * n for n in counts]):
                few = batch.slice(a, b - a)
                ids = few.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = [decoder.decode(x) for x in np.split(ids, np.cumsum(counts[a:b])[:-1])]
                yield pa.RecordBatch.from_arrays([*few.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
