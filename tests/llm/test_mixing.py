import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from hazeflow.llm import mixing

from .conftest import ODD


def targets(sizes, cap=3.0):
    """Cut and reshare until none is above its limit. sizes: source -> words."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    ratio = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * ratio[s] / sum(ratio[f] for f in free) for s in free}
        above = [s for s in free if share[s] > cap * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed |= {s: cap * sizes[s] for s in above}


def plain(rows, quality={}):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sources = {}
    for r, n in zip(rows, size):
        sources[r[3]] = sources.get(r[3], 0) + n
    want = targets(sources)
    out = []
    for s in sources:
        epochs = math.floor(want[s] / sources[s]) if sources[s] else 0
        rest, upto = want[s] - epochs * sources[s], 0
        own = []
        for r, n in zip(rows, size):
            if r[3] == s:
                name = "null" if r[0] is None else str(r[0])
                u = (int(hashlib.md5(f"42:{name}".encode()).hexdigest()[:13], 16) + 1) / 2**52
                own.append((-math.log(u) / quality.get(r[0], 1.0), -1 if r[0] is None else r[0], n))
        for key, d, n in sorted(own):
            upto += n
            out.append((d, n, sources[s], round(want[s], 6), n * (epochs + (2 * upto - n <= 2 * rest and rest > 0))))
    return sorted(out)


def got(docs):
    rows = mixing.mix(docs).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in rows)


@pytest.mark.parametrize("range_rows", [1, 7, 1000])
def test_equals_plain_form(make_docs, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    rows = [(i, "w " * (1 + i * i % 57), "en", None if i % 11 == 0 else f"s{min(i % 7, 3)}") for i in range(150)]
    rows += [(200, "x " * 3, "en", "tiny"), (201, "", "en", "empty"), (202, None, "en", "empty")]
    assert got(make_docs(rows)) == plain(rows)


def test_odd_rows(make_docs):
    rows = [r if len(r) > 3 else (*r, "en", "s") for r in ODD]
    a, b = got(make_docs(rows, extra=True)), plain(rows)
    # Repeated rows are taken together, or not at all.
    assert [x[:4] for x in a] == [x[:4] for x in b]
    assert len({x[4] for x in a if x[0] == 1}) == 1
    assert got(make_docs([])) == []


def test_documents_of_the_mix(make_docs):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 4}") for i in range(80)]
    docs = make_docs(rows, extra=True)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {x[0]: x[4] // x[1] for x in plain(rows)}
    assert n == {d: c for d, c in want.items() if c}


def test_quality_raises_the_share(spark, make_docs):
    docs = make_docs([(i, "w w", "en", f"s{i % 2}") for i in range(600)])
    quality = spark.createDataFrame([(i, 9.0 if i % 4 == 0 else None) for i in range(600)], "doc_id long, quality double")
    r = mixing.mix(docs, quality).where("source = 's0'").groupBy((F.col("doc_id") % 4).alias("k")).agg(F.avg("copies").alias("c"))
    c = {x.k: x.c for x in r.collect()}
    assert c[0] > c[2] + 0.2
