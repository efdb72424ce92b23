import random
import zlib

from hazeflow.llm import sharding

from .conftest import ODD


def check(docs, rows, n=16):
    out = sharding.shard_slots(docs, n).collect()
    text = lambda r: r[1] or ""
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted((str(r[0]), len(text(r).encode()) + 1, zlib.crc32(text(r).encode())) for r in rows)
    for s in range(n):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    shards = {}
    for r in out:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(x) == 1 for x in shards.values()) and all(0 <= r.shard < n for r in out)
    return [sum(r["size"] for r in out if r.shard == s) for s in range(n)]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    sizes = check(docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert max(sizes) - min(sizes) < 0.02 * max(sizes)


def test_hot_group_and_small_runs(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 5)
    rows = [(i, "copy " * 20) for i in range(150)] + [(1000 + i, f"text {i} " * (1 + i % 13)) for i in range(300)]
    sizes = check(make_docs(rows), rows, 4)
    others = sorted(sizes)[:-1]
    assert max(others) - min(others) < 0.03 * max(others)


def test_odd_rows(make_docs):
    check(make_docs(ODD, extra=True), ODD)
    assert sharding.shard_slots(make_docs([])).count() == 0
    out = sharding.shard_documents(make_docs(ODD, extra=True), 3)
    assert out.columns.count("shard") == 1 and out.count() == len(ODD) and {r.shard for r in out.collect()} <= {0, 1, 2}


def test_best_fit_equals_a_plain_search():
    rnd = random.Random(3)
    for _ in range(20):
        sizes = sorted((rnd.randint(1, 60) for _ in range(200)), reverse=True)
        free, bins = [], []
        for s in sizes:
            fit = min(((f, i) for i, f in enumerate(free) if f >= s), default=None)
            if fit is None:
                free.append(100)
                fit = (100, len(free) - 1)
            free[fit[1]] -= s
            bins.append(fit[1])
        assert sharding.best_fit_decreasing(sizes, 100) == bins
        even = sharding.even_bins(sizes, 7)
        filled = [sum(s for s, b in zip(sizes, even) if b == k) for k in range(7)]
        assert max(filled) - min(filled) <= 60 and set(even) == set(range(7))
