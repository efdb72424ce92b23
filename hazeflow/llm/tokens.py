"""Token ids in files of fixed-width bits, with block offsets for random access.

Documents are dealt out by ranges of their id, encoded where they land, and every
task writes the ids of its range, in order, to files of its own. A file holds
blocks of ``BLOCK_IDS`` ids, each id in as few bits as the vocabulary needs, then the byte
offset of every block and the documents' token counts. ``PackedFile.ids`` reads any span
by unpacking just the blocks it touches, with numpy.

A task names its files afresh at each attempt and returns one manifest row per file. Spark
commits the manifest; files of lost or repeated attempts are named in no manifest and are
never read. File positions become corpus positions by a running sum over the manifest, one row per file.

Encoding. Tokens of these vocabularies never span white space, so a text is split there
and each distinct piece is encoded once per Python worker; a bounded cache keeps the ids.

Defined results. Null or empty text: only the end id. Null ids come first. Rows with equal ids are
kept, in order of a hash of their text. Empty table: no files, no rows.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazeflow.session import materialize, work_dir

from .base import parts

MAGIC = b"HZPACK01"
TAIL = struct.Struct("<IIQQQQ8s")
#: Ids of a block: a multiple of 8, so that every block starts on a byte.
BLOCK_IDS = 1 << 16
#: A file is closed after the document that brings it to so many ids.
FILE_IDS = 1 << 24
CACHE_WORDS = 800_000

# Control characters that Python's split takes for white space and the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PIECES = re.compile("(?:\\S|[\x1c-\x1f])+")
_END = " "


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class PackedWriter:
    """Writes one file; documents are added in order."""

    def __init__(self, sink, width: int, block_ids: int = BLOCK_IDS) -> None:
        self.sink, self.width, self.block_ids = sink, width, block_ids
        self.offsets, self.doc_ids, self.known, self.counts = [], [], [], []
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0
        sink.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.counts.append(len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        self.n_ids += len(ids)
        if self.n_pending >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for a in range(0, whole, self.block_ids):
            data = pack_bits(ids[a : min(whole, a + self.block_ids)], self.width)
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.pending, self.n_pending = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for values, kind in ((self.offsets, "<u8"), (self.doc_ids, "<i8"), (self.known, "<u1"), (self.counts, "<u8")):
            self.sink.write(np.asarray(values, kind).tobytes())
        self.sink.write(TAIL.pack(self.width, self.block_ids, self.n_ids, len(self.counts), len(self.offsets), self.at, MAGIC))
        self.sink.close()


class PackedFile:
    """Random access to the ids and documents of one file."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - TAIL.size)
        self.width, self.block_ids, self.n_ids, n_docs, n_blocks, self.end, magic = TAIL.unpack(source.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        source.seek(self.end)
        read = lambda n, kind: np.frombuffer(source.read(n * np.dtype(kind).itemsize), kind)
        self.offsets, self.doc_ids = read(n_blocks, "<u8"), read(n_docs, "<i8")
        self.known, self.counts = read(n_docs, "<u1"), read(n_docs, "<u8").astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at file positions start to stop, from the blocks they lie in."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        self.source.seek(int(self.offsets[first]))
        until = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        data = self.source.read(until - int(self.offsets[first]))
        n = min(self.n_ids, (last + 1) * self.block_ids) - first * self.block_ids
        return unpack_bits(data, n, self.width)[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self, step: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document; about ``step`` ids are in memory at a time."""
        ends = np.cumsum(self.counts)
        i = 0
        while i < len(ends):
            start = int(ends[i] - self.counts[i])
            j = max(i + 1, int(np.searchsorted(ends, start + step, "right")))
            ids = self.ids(start, int(ends[j - 1]))
            for k in range(i, j):
                a, b = int(ends[k] - self.counts[k]) - start, int(ends[k]) - start
                yield (int(self.doc_ids[k]) if self.known[k] else None), start + a, ids[a:b]
            i = j


def _ends_in_letter(word: str) -> bool:
    """Whether it still does in normal form C and lower case; there some letters become a letter and a mark."""
    return word.isascii() or unicodedata.normalize("NFC", word).lower()[-1].isalpha()


class _Pieces(dict):
    """Piece -> number; a new piece gets the next number and waits to be encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.waiting.append(piece)
        return number


class Encoder:
    """Encodes texts with a tokenizers vocabulary whose tokens never span white space."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.flat, self.starts, self.sizes = _Pieces(), array("I"), array("q"), array("q")
        self.numbers[_END] = 0
        self._store([self.end_id])

    def _store(self, ids: list[int]) -> None:
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)

    @staticmethod
    def pieces(text: str) -> list[str]:
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()  # there, as the tokenizer lowers it
            except UnicodeEncodeError:
                pass
        return _PIECES.findall(text) if _SEPARATORS.search(text) else text.split()

    def _settle(self) -> None:
        """Encode what waits. A word and the punctuation mark behind it are separate tokens if the word ends in a letter once normalised."""
        waiting, whole, joined = self.numbers.waiting, [], {}
        first = len(self.starts)
        k = 0
        while k < len(waiting):
            w = waiting[k]
            if len(w) > 1 and w[-1] in ".,;:!?" and w[:-1].isalpha() and _ends_in_letter(w[:-1]):
                joined[k] = (self.numbers[w[:-1]], self.numbers[w[-1]])
            else:
                whole.append(k)
            k += 1
        encoded = self.tokenizer.encode_batch_fast([waiting[k] for k in whole], add_special_tokens=False)
        found = {k: e.ids for k, e in zip(whole, encoded)}
        get = lambda n: found[n - first] if n >= first else list(self.flat[self.starts[n] : self.starts[n] + self.sizes[n]])
        for k in range(len(waiting)):
            self._store(found[k] if k in found else get(joined[k][0]) + get(joined[k][1]))
        self.numbers.waiting = []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.numbers) > CACHE_WORDS:
            self._clear()
        numbers, ends, at = array("q"), [], self.numbers.__getitem__
        for text in texts:
            if text:
                numbers.extend(map(at, self.pieces(text)))
            numbers.append(0)
            ends.append(len(numbers))
        if self.numbers.waiting:
            self._settle()
        of = np.frombuffer(numbers, np.int64)
        sizes = np.frombuffer(self.sizes, np.int64)[of]
        upto = np.cumsum(sizes)
        places = np.repeat(np.frombuffer(self.starts, np.int64)[of] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
        ids = np.frombuffer(self.flat, np.uint32)[places]
        return np.split(ids, upto[np.asarray(ends, np.int64) - 1][:-1]) if ends else []

    @property
    def bits(self) -> int:
        return bits_for(max(self.tokenizer.get_vocab_size(), self.end_id + 1))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    """One per Python worker, so that tasks that follow one another share its cache."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _slices(batch: pa.RecordBatch, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def write_packed(docs: DataFrame, vocabulary: str, end_id: int, folder: str) -> DataFrame:
    """Write the ids of all documents in order of doc_id below ``folder``; returns the manifest.

    The manifest has path, part, seq, n_docs, n_ids, and base, the number of ids in all files before.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts(spark), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, attempt = encoder_of(vocabulary, end_id), TaskContext.get().partitionId(), uuid.uuid4().hex
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        done, writer = [], None
        for batch in batches:
            for few in _slices(batch):
                for doc_id, ids in zip(few.column("doc_id").to_pylist(), encoder.encode(few.column("text").to_pylist())):
                    if writer is None:
                        name = f"ids-{part:06d}-{len(done):04d}-{attempt}.bin"
                        writer = PackedWriter(system.open_output_stream(f"{root}/{name}"), encoder.bits)
                    writer.add(doc_id, ids)
                    if writer.n_ids >= FILE_IDS:
                        writer.close()
                        done.append((name, part, len(done), len(writer.counts), writer.n_ids))
                        writer = None
        if writer is not None:
            writer.close()
            done.append((name, part, len(done), len(writer.counts), writer.n_ids))
        if done:
            name, number, seq, n_docs, n_ids = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(number, pa.int64()), pa.array(seq, pa.int64()), pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64())],
                names=["name", "part", "seq", "n_docs", "n_ids"],
            )

    schema = "name string, part long, seq long, n_docs long, n_ids long"
    files = materialize(dealt.mapInArrow(write, schema), "token-manifest")
    before = F.sum("n_ids").over(W.orderBy("part", "seq")) - F.col("n_ids")
    return files.select(F.concat(F.lit(f"{folder}/"), "name").alias("path"), "part", "seq", "n_docs", "n_ids", before.alias("base"))


def read_packed(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit little-endian ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                system, place = pafs.FileSystem.from_uri(path)
                with system.open_input_file(place) as source:
                    rows = [(d, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, start, ids in PackedFile(source).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartition(parts(manifest.sparkSession), "path")
    return spread.select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int) -> tuple[DataFrame, DataFrame]:
    """(manifest, documents read back), files in the shared folder."""
    folder = work_dir(docs.sparkSession, "token-ids")
    if "://" not in folder:
        folder = f"file://{folder}"
    manifest = materialize(write_packed(docs, vocabulary, end_id, folder), "token-index")
    return manifest, read_packed(manifest)
