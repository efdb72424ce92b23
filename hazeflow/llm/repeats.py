"""Repeated passages: remove every byte covered by a 100-byte string that also starts earlier in the corpus.

Strings are judged on the input; earlier is by document (null ids last, equal ids by a hash of their text), then by start.

Anchors bring equal strings together. Of the 16-byte grams of a 100-byte window the one with the smallest hash is the
window's anchor (minimizer). Equal windows have equal anchors at equal places, and neighbouring windows mostly
share theirs. A task cuts its documents into the runs of windows that share an anchor; the bytes such a run spans are
its context, and contexts are sent to the task of their anchor's hash. A context that a document before it in the same task has too is settled
there and not sent. A long text is worked on in pieces that overlap by 99 bytes, so that no text is too long.

Suffix sort. Where contexts meet, those of one anchor are sorted from the anchor to the right, and from the anchor to the left,
by merging. Two suffixes are compared by their common extension, found by binary search on prefix
polynomial hashes, in a logarithmic number of steps. Adjacent common extensions then say, for each place of the window
over the anchor, which contexts hold equal windows: those with an unbroken chain of long enough extensions on both sides. All but
the earliest of such a class are repeats. The claimed extensions are verified byte by byte; should a hash have
collided, the chunk is sorted by its bytes instead.

Hot anchors. Anchors with more than about one in ``HOT_SHARE`` of all occurrences would gather in one task. They are known from a
counting pass in which tasks report what is frequent among their own; there can be no more than 4 * HOT_SHARE of them. Their windows are
dealt out by a 128-bit hash of the window itself, each task sending a window once, so only equal windows meet, and those once per task.

Defined results. Null text: empty. Texts of fewer than 100 bytes: nothing removed. Rows with equal id and text are one
document and return the same. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeflow.session import materialize

from .base import parts, text_of

LENGTH = 100
GRAM = 16
HOT_SHARE = 20_000
#: Bytes of text handled at once. A slice stays below twice that and a window, so positions fit into 26 bits.
SLICE = 1 << 21
#: Bytes of context sorted at once (a larger group of one anchor is sorted whole).
CHUNK = 1 << 21
LAST = np.iinfo(np.int64).max
_RNG = np.random.default_rng(20)
_TABLES = _RNG.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 26) - 1)


def _powers(step: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(step))
    out[:1] = 1
    return np.multiply.accumulate(out)


class PrefixHash:
    """Polynomial hashes, modulo 2^64, of any stretch of a byte array."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        self.back = _powers(pow(_STEP[which], -1, 1 << 64), len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * _powers(_STEP[which], len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@dataclass
class Runs:
    """Runs of windows with one anchor: places are in the joined text, ``doc`` numbers the documents."""

    data: np.ndarray
    begin: np.ndarray  # where each document begins
    doc: np.ndarray
    first: np.ndarray  # start of the first window
    last: np.ndarray
    anchor: np.ndarray
    hash: np.ndarray


def runs_of(texts: list[bytes]) -> Runs:
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return Runs(data, begin, none, none, none, none, none.view(np.uint64))
    grams = PrefixHash(data).of(np.arange(len(data) - GRAM + 1), GRAM)
    width = LENGTH - GRAM + 1
    marked = (_mixed(grams) & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    full = np.concatenate((marked, np.full(-len(marked) % width, np.uint64(2**64 - 1)))).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[: len(marked) - width + 1], ahead[width - 1 : len(marked)]) & _PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + LENGTH <= (begin + sizes)[doc])
    least, doc = least[start], doc[start]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])][: len(start)])
    end = np.r_[new[1:], len(start)] - 1
    return Runs(data, begin, doc[new], start[new], start[end], least[new], grams[least[new]])


def _grams_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The anchors' hashes, as ``PrefixHash`` has them."""
    out = np.zeros(len(at), np.uint64)
    for j, power in enumerate(_powers(_STEP[0], GRAM)):
        out += _TABLES[0][data[at + j]] * power
    return out


# --- where contexts meet ---


@dataclass
class Contexts:
    """Contexts in order of anchor hash: bytes, where each begins, its anchor's place in it, windows, and whose it is."""

    data: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    left: np.ndarray
    hash: np.ndarray
    prior: np.ndarray  # rank in corpus order of the first window; equal ranks are the same place


def _extension(hashes: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common extension of the suffixes at a and b, at most ``most`` (below 256), by binary search."""
    found = np.zeros(len(a), np.int64)
    for step in (128, 64, 32, 16, 8, 4, 2, 1):
        try_ = found + step
        ok = np.flatnonzero(try_ <= most)
        same = hashes.of(a[ok], try_[ok]) == hashes.of(b[ok], try_[ok])
        found[ok[same]] += step
    return found


def merge_sorted(data: np.ndarray, start: np.ndarray, size: np.ndarray, group_begin: np.ndarray, group_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within each group, and each one's common extension with the one before it (-1 at a group's first)."""
    n, hashes = len(start), PrefixHash(data)
    padded = np.r_[data.astype(np.int16), np.int16(-1)]
    group_of = np.repeat(np.arange(len(group_begin)), group_size)
    place = np.arange(n) - group_begin[group_of]
    order = np.arange(n)

    def below(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y; equal ones do where ``or_equal``."""
        most = np.minimum(size[x], size[y])
        e = _extension(hashes, start[x], start[y], most)
        cx = np.where(e < size[x], padded[np.minimum(start[x] + e, len(data))], -1)
        cy = np.where(e < size[y], padded[np.minimum(start[y] + e, len(data))], -1)
        return (cx < cy) | ((cx == cy) & or_equal)

    width = 1
    while len(group_size) and width < group_size.max():
        at = np.flatnonzero(group_size[group_of] > width)
        g, q = group_of[at], place[at]
        run = q // width
        other = run ^ 1
        low = np.minimum(other * width, group_size[g])
        high = np.minimum(low + width, group_size[g])
        base, low0, right = group_begin[g], low.copy(), (run & 1) == 1
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            # Count the sibling's suffixes below this one; equal ones of the left run come first.
            goes = below(order[base[open_] + mid], order[at[open_]], right[open_])
            low[open_] = np.where(goes, mid + 1, low[open_])
            high[open_] = np.where(goes, high[open_], mid)
        target = base + (run // 2) * 2 * width + (q - run * width) + (low - low0)
        moved = order.copy()
        moved[target] = order[at]
        order = moved
        width *= 2
    extension = np.full(n, -1)
    inner = np.flatnonzero(place > 0)
    a, b = order[inner - 1], order[inner]
    extension[inner] = e = _extension(hashes, start[a], start[b], np.minimum(size[a], size[b]))
    for k in range(0, int(e.max(initial=0))):  # verification
        some = e > k
        if (data[start[a[some]] + k] != data[start[b[some]] + k]).any():
            return _byte_sorted(data, start, size, group_begin, group_size)
    return order, extension


def _byte_sorted(data, start, size, group_begin, group_size):
    """The same from the bytes themselves."""
    raw, order, extension = data.tobytes(), [], []
    for b, n in zip(group_begin.tolist(), group_size.tolist()):
        text = {i: raw[start[i] : start[i] + size[i]] for i in range(b, b + n)}
        own = sorted(text, key=lambda i: text[i])
        for i, j in zip([None, *own], own):
            pair = [] if i is None else [x == y for x, y in zip(text[i], text[j])]
            extension.append(-1 if i is None else (pair.index(False) if False in pair else len(pair)))
        order += own
    return np.array(order, np.int64), np.array(extension, np.int64)


def repeated_windows(c: Contexts) -> np.ndarray:
    """contexts x offsets, true where the window that starts ``offset`` bytes before the anchor also starts earlier."""
    n, most = len(c.begin), LENGTH - GRAM
    out = np.zeros((n, most + 1), bool)
    group_begin = np.flatnonzero(np.r_[True, c.hash[1:] != c.hash[:-1]][:n])
    group_size = np.diff(np.r_[group_begin, n])
    right_order, right_ext = merge_sorted(c.data, c.begin + c.left, c.size - c.left, group_begin, group_size)
    ends = len(c.data) - (c.begin + c.left)  # the left parts, read backwards
    left_order, left_ext = merge_sorted(c.data[::-1], ends, c.left, group_begin, group_size)
    number = np.empty(n, np.int64)
    windows = c.size - LENGTH + 1
    for offset in range(most + 1):
        has = np.flatnonzero((offset <= c.left) & (offset > c.left - windows))
        if len(has) < 2:
            continue
        number[left_order] = np.cumsum(left_ext < offset)
        left = number[has]
        number[right_order] = np.cumsum(right_ext < LENGTH - offset)
        kind = left * (n + 1) + number[has]
        order = np.lexsort((c.prior[has], kind))
        kind, prior = kind[order], c.prior[has][order]
        head = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
        earliest = np.repeat(prior[head], np.diff(np.r_[head, len(kind)]))
        out[has[order[prior > earliest]], offset] = True
    return out


# --- tasks ---

_KINDS = "kind int, bucket int, blob binary"


_TYPES = ["u1", "u4", "i8", "u8"]


def _pack(**columns: np.ndarray) -> bytes:
    """Arrays of one blob, compressed."""
    head = [np.array([len(columns)], "<i8")]
    for values in columns.values():
        head.append(np.array([len(values), _TYPES.index(values.dtype.str[1:])], "<i8"))
    return zstandard.ZstdCompressor(level=6).compress(b"".join(x.tobytes() for x in (*head, *columns.values())))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    shape = np.frombuffer(raw, "<i8", 2 * k, 8).reshape(k, 2)
    out, at = [], 8 + 16 * k
    for n, kind in shape.tolist():
        dtype = np.dtype(f"<{_TYPES[kind]}")
        out.append(np.frombuffer(raw, dtype, n, at))
        at += n * dtype.itemsize
    return out


def _pieces(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of pieces of a text. They overlap by one byte less than a window, so each window is in one piece."""
    for at in range(0, max(1, len(raw) - LENGTH + 1), SLICE):
        yield at, raw[at : at + SLICE + LENGTH - 1]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, hashes of text, offsets in it, pieces of text) of about SLICE bytes; a null id is LAST."""
    rows, size = [], 0

    def columns():
        ids, marks, offsets, texts = zip(*rows)
        return np.array(ids, np.int64), np.array(marks, np.int64), np.array(offsets, np.int64), list(texts)

    for b in batches:
        for d, t, x in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), b.column("text")):
            for offset, piece in _pieces(x.as_py().encode("utf-8", "surrogatepass")):
                rows.append((LAST if d is None else d, t, offset, piece))
                size += len(piece)
                if size >= SLICE:
                    yield columns()
                    rows, size = [], 0
    if rows:
        yield columns()


def _rank(*columns: np.ndarray) -> np.ndarray:
    """Rank of each row; equal rows rank equal."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _spans(ids, marks, starts, stops) -> pa.RecordBatch:
    """Start and stop of a span share a long, since many spans are shuffled."""
    known = ids != LAST
    span = (starts << 32) | stops
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=~known), pa.array(marks, pa.int64()), pa.array(span, pa.int64())], names=["doc_id", "t", "span"])


def _row(kind: int, bucket: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], names=["kind", "bucket", "blob"])


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for some in np.split(order, cuts):
        if len(some):
            yield int(bucket[some[0]]), some


CONTEXTS, WINDOWS, SETTLED = 0, 1, 2


def _cut(hot: np.ndarray, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, marks, offsets, texts in _slices(batches):
            r = runs_of(texts)
            if not len(r.doc):
                continue
            is_hot = np.isin(r.hash, hot)
            place = r.first - r.begin[r.doc] + offsets[r.doc]
            prior = _rank(ids[r.doc], marks[r.doc], place)
            # Contexts that stand earlier in this task are settled.
            cold = np.flatnonzero(~is_hot)
            whole = PrefixHash(r.data)
            second = PrefixHash(r.data, 1)
            a, b = (h.of(r.first[cold], r.last[cold] - r.first[cold] + LENGTH) for h in (whole, second))
            shape = ((r.anchor - r.first)[cold] << 16) + (r.last - r.first)[cold]
            same = _rank(a, b, shape)
            order = np.lexsort((prior[cold], same))
            s, p = same[order], prior[cold][order]
            head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
            least = np.repeat(p[head], np.diff(np.r_[head, len(s)]))
            later, kept = cold[order[p > least]], np.sort(cold[order[head]])
            if len(later):
                yield _row(SETTLED, int(marks[0] % n_buckets), _pack(i=ids[r.doc[later]], m=marks[r.doc[later]], a=place[later], b=place[later] + r.last[later] - r.first[later] + LENGTH))
            for bucket, at in _dealt((_mixed(r.hash[kept] + np.uint64(5)) % np.uint64(n_buckets)).astype(np.int64)):
                at = kept[at]
                size = r.last[at] - r.first[at] + LENGTH
                where = np.repeat(r.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                docs, begin, count = np.unique(r.doc[at], return_index=True, return_counts=True)
                # Places as steps from the one before in the document; the anchor's hash can be had from the bytes.
                step = np.diff(place[at], prepend=0)
                step[begin] = place[at[begin]]
                yield _row(CONTEXTS, bucket, _pack(
                    i=ids[docs], m=marks[docs], count=count.astype("<u4"), step=step.astype("<u4"), more=(size - LENGTH).astype("<u1"),
                    left=(r.anchor - r.first)[at].astype("<u1"), data=r.data[where],
                ))
            warm = np.flatnonzero(is_hot)
            if len(warm):
                n = r.last[warm] - r.first[warm] + 1
                start = np.repeat(r.first[warm] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                doc = np.repeat(r.doc[warm], n)
                a, b = whole.of(start, LENGTH), second.of(start, LENGTH)
                yield from _window_rows(ids[doc], marks[doc], start - r.begin[doc] + offsets[doc], a, b, n_buckets)

    return run


def _window_rows(ids, marks, place, a, b, n_buckets) -> Iterator[pa.RecordBatch]:
    prior, same = _rank(ids, marks, place), _rank(a, b)
    order = np.lexsort((prior, same))
    s, p = same[order], prior[order]
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    later = np.sort(order[p > np.repeat(p[head], np.diff(np.r_[head, len(s)]))])
    if len(later):
        yield _row(SETTLED, int(marks[0] % n_buckets), _merged(ids[later], marks[later], place[later]))
    first = np.sort(order[head])
    for bucket, at in _dealt((_mixed(a[first] + np.uint64(3)) % np.uint64(n_buckets)).astype(np.int64)):
        at = first[at]
        yield _row(WINDOWS, bucket, _pack(i=ids[at], m=marks[at], place=place[at], a=a[at], b=b[at]))


def _joined(ids, marks, starts, stops):
    """Spans of a document that touch or overlap, joined."""
    order = np.lexsort((stops, starts, marks, ids))
    ids, marks, starts, stops = (x[order] for x in (ids, marks, starts, stops))
    # A document's stops, raised above those of all documents before it.
    new_doc = np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])][: len(ids)]
    lift = np.cumsum(new_doc) * (int(stops.max(initial=0)) + 1)
    reach = np.maximum.accumulate(stops + lift) - lift
    new = new_doc.copy()
    new[1:] |= starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return ids[at], marks[at], starts[at], reach[np.r_[at[1:], len(ids)] - 1] if len(at) else stops


def _merged(ids, marks, place) -> bytes:
    i, m, a, b = _joined(ids, marks, place, place + LENGTH)
    return _pack(i=i, m=m, a=a, b=b)


def _settle_contexts(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    cols = [_unpack(b) for b in blobs]
    ids = np.concatenate([np.repeat(c[0], c[2]) for c in cols])
    marks = np.concatenate([np.repeat(c[1], c[2]) for c in cols])
    step, more, left = (np.concatenate([c[k] for c in cols]).astype(np.int64) for k in (3, 4, 5))
    count = np.concatenate([c[2] for c in cols]).astype(np.int64)
    first = np.cumsum(count) - count
    along = np.cumsum(step)
    place = along - np.repeat(along[first] - step[first], count)
    data = np.concatenate([c[6] for c in cols])
    size = more + LENGTH
    begin = np.cumsum(size) - size
    h = _grams_at(data, begin + left)
    del cols, step, more, along  # the unpacked blobs are not needed any more
    order = np.argsort(h, kind="stable")
    head = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]][: len(h)])
    group = np.diff(np.r_[head, len(h)])
    met = order[np.repeat(group > 1, group)]
    if not len(met):
        return
    prior = _rank(ids[met], marks[met], place[met])
    bounds = np.flatnonzero(np.r_[True, h[met][1:] != h[met][:-1]])
    chunk = np.cumsum(size[met])[bounds] // CHUNK
    cuts = bounds[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])]
    for x, y in zip(cuts, np.r_[cuts[1:], len(met)]):
        some = met[x:y]
        where = np.repeat(begin[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
        c = Contexts(data[where], np.cumsum(size[some]) - size[some], size[some], left[some], h[some], prior[x:y])
        i, offset = np.nonzero(repeated_windows(c))
        if len(i):
            at = place[some][i] + left[some][i] - offset
            yield _joined(ids[some][i], marks[some][i], at, at + LENGTH)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind and bucket; a bucket's blobs together."""
    held: list[bytes] = []
    key = None

    def flush():
        if key is None:
            return
        if key[0] == SETTLED:
            for blob in held:
                yield _spans(*_unpack(blob))
        elif key[0] == CONTEXTS:
            for found in _settle_contexts(held):
                yield _spans(*found)
        else:
            ids, marks, place, a, b = (np.concatenate(x) for x in zip(*map(_unpack, held)))
            prior, same = _rank(ids, marks, place), _rank(a, b)
            order = np.lexsort((prior, same))
            s, p = same[order], prior[order]
            head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            later = order[p > np.repeat(p[head], np.diff(np.r_[head, len(s)]))]
            if len(later):
                yield _spans(*_joined(ids[later], marks[later], place[later], place[later] + LENGTH))

    for batch in batches:
        for kind, bucket, blob in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            if (kind, bucket) != key:
                yield from flush()
                key, held = (kind, bucket), []
            held.append(blob)
    yield from flush()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("t", F.xxhash64("text"))


def hot_anchors(keyed: DataFrame) -> np.ndarray:
    """Anchors with at least one in 2 * HOT_SHARE of all occurrences, as tasks' reports of what is frequent among their own show.

    Whatever has one in HOT_SHARE is among them: at most half of it can be in tasks that do not report it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, texts in _slices(batches):
            h, n = np.unique(runs_of(texts).hash, return_counts=True)
            report = n * 2 * HOT_SHARE >= n.sum()
            rows = [np.r_[h[report].view(np.int64), 0], np.r_[n[report], 0], np.r_[np.zeros(report.sum(), np.int64), n.sum()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["h", "n", "all"])

    counts = keyed.select("doc_id", "t", "text").mapInArrow(count, "h long, n long, all long")
    counts = materialize(counts.where("n > 1 OR `all` > 0").groupBy("h").agg(F.sum("n").alias("n"), F.sum("all").alias("all")), "repeat-counts")
    total = counts.agg(F.sum("all")).first()[0] or 0
    least = max(2000, total // (2 * HOT_SHARE))
    return np.sort(np.array([r.h for r in counts.where(F.col("n") >= least).select("h").collect()], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, t, span): stretches of repeated bytes, some overlapping; t is the text's hash, span is start * 2^32 + stop."""
    spark, keyed = docs.sparkSession, _keyed(docs)
    hot = hot_anchors(keyed)
    n_buckets = parts(spark)
    rows = keyed.select("doc_id", "t", "text").mapInArrow(_cut(hot, n_buckets), _KINDS)
    meet = rows.repartition(n_buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    return meet.mapInArrow(_settle, "doc_id long, t long, span long")


def without_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""
    spans = repeated_spans(docs).groupBy(F.col("doc_id").alias("d"), F.col("t").alias("s")).agg(F.collect_set("span").alias("spans"))

    def shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = [pack.compress(x.as_py().encode("utf-8", "surrogatepass")) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(raw, pa.binary())], names=["doc_id", "t", "raw"])

    # Texts meet their spans compressed.
    keyed = _keyed(docs).select("doc_id", "t", "text").mapInArrow(shrunk, "doc_id long, t long, raw binary")
    wide = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["d"]) & (keyed["t"] == spans["s"]), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for x, spans in zip(b.column("raw"), b.column("spans")):
                raw, kept, at, n, removed = unpack.decompress(x.as_py()), [], 0, 0, 0
                edge = -1
                for s in sorted((s >> 32, s & 0xFFFFFFFF) for s in spans.as_py() or ()):
                    if s[0] > edge:
                        n += 1
                        kept.append(raw[at : s[0]])
                        at = s[0]
                    edge = max(edge, s[1])
                    removed += max(0, s[1] - at)
                    at = max(at, s[1])
                kept.append(raw[at:])
                left = b"".join(kept)
                rows.append((len(raw), removed, n, hashlib.sha256(left).hexdigest(), left if keep_text else None))
            columns = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = wide.select("doc_id", "raw", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")
