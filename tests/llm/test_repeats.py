import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from hazeflow.llm import repeats

from .conftest import ODD


def plain(rows):
    """By a set of all 100-byte strings in corpus order; equal ids and texts are one document."""
    mark = lambda raw: np.uint64(xxhash.xxh64_intdigest(raw, 42)).view(np.int64)
    texts = sorted({((r[0] is None, r[0] or 0), (r[1] or "").encode()) for r in rows}, key=lambda x: (x[0], mark(x[1])))
    seen, out = set(), {}
    for key, raw in texts:
        gone = np.zeros(len(raw) + 1, bool)
        for a in range(len(raw) - 99):
            s = raw[a : a + 100]
            if s in seen:
                gone[a : a + 100] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.r_[False, gone[:-1], False].astype(int)))
        kept = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
        out[key, raw] = (len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest())
    return sorted((str(r[0]), *out[(r[0] is None, r[0] or 0), (r[1] or "").encode()]) for r in rows)


def check(docs, rows):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs).collect())
    assert got == plain(rows)
    return sum(r[2] for r in got)


def corpus(seed, n=90):
    rnd = random.Random(seed)
    make = lambda k: "".join(rnd.choice("ab é\n") for _ in range(k))
    passages = [make(rnd.choice((60, 99, 100, 101, 150, 400))) for _ in range(12)]
    rows = []
    for d in range(n):
        text = "".join(make(rnd.randrange(80)) + rnd.choice(passages)[rnd.randrange(20) :] for _ in range(rnd.randrange(4)))
        rows.append((d, text if d % 7 or not rows else rnd.choice(rows)[1]))
    return rows + [(n, "ab" * 300), (n + 1, "x" + "ab" * 120), (n + 2, "q" * 99), (n + 3, "q" * 100), (n + 4, "q" * 101)]


@pytest.mark.parametrize("hot_share", [20_000, 1])
def test_equals_plain_form(make_docs, monkeypatch, hot_share):
    rows = corpus(hot_share)
    assert check(make_docs(rows), rows) > 1000


def test_hot_anchors_take_the_other_way(make_docs, monkeypatch):
    rows = corpus(9)
    hot = {}

    def all_of(keyed):
        hot["h"] = np.unique(repeats.runs_of([(r[1] or "").encode() for r in rows]).hash)
        return hot["h"]

    monkeypatch.setattr(repeats, "hot_anchors", all_of)
    check(make_docs(rows), rows)
    monkeypatch.setattr(repeats, "hot_anchors", lambda keyed: hot["h"][::2])
    check(make_docs(rows), rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    assert check(docs, [(r.doc_id, r.text) for r in docs.collect()]) > 0


def test_odd_rows(make_docs):
    rows = [*ODD, (30, "p" * 5 + "0123456789" * 12), (30, "0123456789" * 12), (None, "0123456789" * 11), (None, "0123456789" * 11)]
    check(make_docs(rows, extra=True), rows)
    assert repeats.without_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_sort(letters):
    rng = np.random.default_rng(letters)
    size = rng.integers(0, 60, 300)
    data = rng.integers(0, letters, size.sum()).astype(np.uint8)
    start = np.cumsum(size) - size
    groups = np.array([1, 2, 3, 94, 200])
    args = (data, start, size, np.cumsum(groups) - groups, groups)
    order, extension = repeats.merge_sorted(*args)
    slow_order, slow_extension = repeats._byte_sorted(*args)
    text = lambda i: data[start[i] : start[i] + size[i]].tobytes()
    assert [text(i) for i in order] == [text(i) for i in slow_order] and list(extension) == list(slow_extension)


def test_anchors_are_those_of_the_window_alone():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 3, 3000).astype(np.uint8).tobytes()
    runs = repeats.runs_of([b"", text, b"short"])
    assert (runs.doc == 1).all() and runs.first[0] == 0 and runs.last[-1] == 2900 and (runs.first[1:] == runs.last[:-1] + 1).all()
    for f, z, a in zip(runs.first, runs.last, runs.anchor):
        for s in (f, z):
            alone = repeats.runs_of([text[s : s + 100]])
            assert alone.anchor[0] == a - s


def removed_here(rows, hot):
    """Places of repeated bytes of (doc_id, text) rows with distinct ids, by the tasks' functions in this process."""
    ids, texts = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([0] * len(ids), pa.int64()), pa.array(texts)], names=["doc_id", "t", "text"])
    sent = sorted(repeats._cut(hot, 3)(iter([batch])), key=lambda b: (b.column("kind")[0].as_py(), b.column("bucket")[0].as_py()))
    gone = {d: np.zeros(len(t.encode()), bool) for d, t in rows}
    for found in repeats._settle(iter(sent)):
        for d, span in zip(found.column("doc_id").to_pylist(), found.column("span").to_pylist()):
            gone[d][span >> 32 : span & 0xFFFFFFFF] = True
    return gone


@pytest.mark.parametrize("hot", ["none", "all"])
def test_a_text_longer_than_the_positions_hold(monkeypatch, hot):
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdé") for _ in range(300))
    noise = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    rows = [(1, noise(700) + passage + noise(9000) + passage + noise(6000) + passage[50:] + noise(1977)), (2, noise(2000) + passage[:180]), (3, noise(1099)), (4, "")]
    monkeypatch.setattr(repeats, "SLICE", 1000)
    monkeypatch.setattr(repeats, "_PLACE", np.uint64((1 << 12) - 1))
    known = np.unique(np.concatenate([repeats.runs_of([t.encode()[a : a + 1200]]).hash for _, t in rows for a in range(0, 20_000, 1000)]))
    gone = removed_here(rows, known if hot == "all" else known[:0])
    seen = set()
    for d, text in rows:
        raw, want = text.encode(), np.zeros(len(text.encode()), bool)
        for a in range(len(raw) - 99):
            if raw[a : a + 100] in seen:
                want[a : a + 100] = True
            seen.add(raw[a : a + 100])
        assert (gone[d] == want).all()
    assert gone[1].sum() > 500 and gone[2].sum() >= 180
