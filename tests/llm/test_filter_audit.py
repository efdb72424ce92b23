import re
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazeflow.llm import filter_audit as fa

from .conftest import ODD

LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """The audit document by document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first, failed = {}, []
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, *rest in docs:
        text, part = text or "", (rest[1] if len(rest) > 1 else "s") or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and doc_id > first[text],
        }
        failed.append((part, {x for x in fails if fails[x]}, doc_id in good, doc_id in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failed}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in failed if f[0] == part]
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                all_failing = [f for f in failed if f[0] == part and x in f[1]]
                out[part, order, step] = [
                    len(left), len(gone), len(all_failing) - len(gone), sum(f[1] == {x} for f in all_failing),
                    sum(f[2] for f in gone), sum(f[3] for f in gone),
                ]
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(spark, docs, labels):
    rows = fa.filter_audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


LABELLED = [(1, 1, 0), (1, 0, None), (2, None, 1), (4, 1, 1), (8, 0, 1), (9, 1, 0), (None, 1, 1), (77, 1, 1)]
MORE = [
    (20, " ".join(f"w{i}" for i in range(60)), "en", "t"), (21, " ".join(f"w{i}" for i in range(60)), "en", "t"), (22, "LOUD " * 70 + "#", "en", "u"),
    (23, " ".join(f"W{i}" for i in range(50)), "en", "u"), (24, " ".join(f"ä{i}" for i in range(49)) + " 5%", "en", ""), (19, "tie", "fr", "t"),
]


def test_equals_plain_walk(spark, make_docs):
    rows = ODD + MORE
    expected = plain(rows, LABELLED)
    assert len(expected) == 600 * 4  # s, t, u, and the empty string for it and for null
    for partitions in (1, 5):
        assert result(spark, make_docs(rows, extra=True, partitions=partitions), LABELLED) == expected


def test_empty_tables(spark, make_docs):
    assert result(spark, make_docs([]), LABELLED) == {}
    assert result(spark, make_docs(MORE), []) == plain(MORE, [])


def test_group_of_copies(spark, make_docs):
    rows = [(i, "x" if i % 3 else f"text {i}", "en", "s" if i % 2 else "t") for i in range(3000)]
    assert result(spark, make_docs(rows), []) == plain(rows, [])


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(*[st.integers(1, 9)] * 3)))
def test_diagram_stays_reduced_under_swaps(weights):
    diagram = fa.Diagram(weights, "ABCDE")
    total = [sum(w[i] for w in weights.values()) for i in range(3)] if weights else [0]
    for order in fa.neighbouring_orders("ABCDE"):
        at = [i for i, (a, b) in enumerate(zip(diagram.order, order)) if a != b]
        assert len(at) in (0, 2)
        if at:
            assert at[1] == at[0] + 1
            diagram.swap(at[0])
        assert "".join(diagram.order) == order
        assert list(diagram.weight[diagram.root]) == total
        for known in diagram.levels:
            assert all((diagram.passing[n], diagram.failing[n]) == k for k, n in known.items())
        for m in range(32):  # a walk to the leaf of a mask
            node = diagram.root
            for x in order:
                node = (diagram.failing if m >> "ABCDE".index(x) & 1 else diagram.passing)[node]
            assert tuple(diagram.weight[node]) == weights.get(m, (0,) * len(total))


def test_too_many_filters(spark):
    counts = spark.createDataFrame([("p", 0, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    with pytest.raises(ValueError):
        fa.audit(counts, "ABCDEFGHI")
    assert fa.audit(counts, "AB").where(F.col("kept") == 1).count() == 4


