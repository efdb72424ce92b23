import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeflow.llm import neighbours


def plain(rows, k=5):
    """Exact results of rows (vec_id, vector), each counted once."""
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)})
    out = {}
    for i, v in ok:
        if i % 50 == 0:
            near = [(-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in ok if j != i]
            out[i] = sorted((round(s, 9), j) for s, j in near)[:k]
    return out


def got(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    if extra:
        df = df.withColumns({c: F.lit("clash") for c in ("v", "q", "h", "list", "rep", "score", "rank")})
    out = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(-r.score, 9), r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("d", [3, 16, 40])
def test_recall(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(d)]) for i in range(2000)]
    want, found = plain(rows), got(spark, rows)
    assert want.keys() == found.keys() and all(len(x) == 5 for x in found.values())
    hits = sum(len({j for _, j in want[q]} & {j for _, j in found[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    score = {(i, j): s for i in want for s, j in want[i]}
    assert all(abs(score[q, j] - s) < 1e-8 for q in found for s, j in found[q] if (q, j) in score)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = plain(rows)
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(found[q] & {j for _, j in want[q]}) for q in want) / (5 * len(want)) >= 0.9


def test_copies_ties_and_odd_rows(spark):
    a, b = [1.0, 2.0, 0.0], [0.0, 1.0, 1.0]
    rows = [(i, a) for i in range(40, 140)] + [(200 + i, b) for i in range(3)] + [(300, [2.0, 4.0, 0.0]), (300, [2.0, 4.0, 0.0])]
    odd = [(400, None), (None, a), (450, [0.0, 0.0, 0.0]), (500, [1.0, None, 1.0]), (550, [float("nan"), 1.0, 0.0]), (600, [float("inf"), 1.0, 0.0]), (650, [1.0])]
    assert got(spark, rows + odd, extra=True) == plain(rows)
    assert plain(rows)[50] == [(-1.0, j) for j in (40, 41, 42, 43, 44)]
    assert got(spark, rows[:3] + [(0, b)]) == plain(rows[:3] + [(0, b)])
    assert got(spark, []) == {} and got(spark, odd) == {} and got(spark, [(1, a)]) == {} and got(spark, [(50, a)]) == {}


@pytest.mark.parametrize("which", ["all twice", "one for a third"])
def test_repeated_rows_do_not_tighten_the_bound(spark, which):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(600)]
    if which == "all twice":
        repeated = rows + rows
    else:
        repeated = rows + [rows[50]] * 300  # a query of its own, and near others
    want, found = plain(rows), got(spark, repeated)
    assert want.keys() == found.keys() and all(len(x) == 5 for x in found.values())
    hits = sum(len({j for _, j in want[q]} & {j for _, j in found[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
    assert found == got(spark, rows)
