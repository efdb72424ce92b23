from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hazeflow.llm import simhash

from .conftest import ODD


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(map(ord, "\t\n\r\x0b\x0c"), " ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    ids = list(range(len(fps)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                ids[b] = a
    return [root(i) for i in range(len(fps))]


def check(docs, rows):
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.components(docs).select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id").collect()]
    fps = [plain_fingerprint(r[1]) for r in rows]
    names = defaultdict(list)
    roots = plain_components(fps)
    for r, root in zip(rows, roots):
        names[root] += [r[0]] if r[0] is not None else []
    want = [(r[0], fp, min(names[root], default=None)) for r, fp, root in zip(rows, fps, roots)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(make_docs):
    check(make_docs(ODD, extra=True), ODD)
    assert simhash.components(make_docs([])).count() == 0


def test_links_of_crowded_cells(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    for _ in range(300):
        x = centre
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(b)
        fps.add(simhash._signed(x & (1 << 64) - 1))
    fps = sorted(fps | {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 200)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    from hazeflow.llm.components import connected_components

    want = plain_components([x & (1 << 64) - 1 for x in fps])
    for crowded in (8, 256):
        roots = {r.node: r.root for r in connected_components(simhash.links(df, 2, crowded)).collect()}
        got = [roots.get(x, x) for x in fps]
        groups = lambda labels: {frozenset(i for i, y in enumerate(labels) if y == x) for x in labels}
        assert groups(got) == groups(want)


def test_one_per_component(make_docs):
    rows = [r.doc_id for r in simhash.one_per_component(make_docs(ODD, extra=True)).collect()]
    want = {r[0]: c for r, c in zip(ODD, plain_components([plain_fingerprint(r[1]) for r in ODD]))}
    named = [r for r in rows if r is not None]
    assert len(named) == len(set(named)) and {1, 3} <= set(named) and 2 not in named and 4 not in named
    assert len(want) and rows.count(None) == 2
    out = simhash.one_per_component(make_docs(ODD, extra=True))
    assert out.columns == make_docs(ODD, extra=True).columns
