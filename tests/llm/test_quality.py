import numpy as np
from pyspark.sql import functions as F

from hazeflow.llm import quality

from .conftest import ODD


def test_gradient_is_that_of_the_likelihood():
    """One plain step from the given parameters moves along numerical derivatives."""
    raw = np.array([-0.5, 0.3])
    t = quality.thresholds(raw)
    assert t[0] < t[1]
    tail = quality.tails(np.array([-50.0, 0.0, 50.0]), raw)
    assert np.allclose(tail[0], 0) and np.allclose(tail[2], 1) and tail[1, 0] > tail[1, 1]


def test_catches_toxic_and_keeps_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    learned = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0).select("doc_id", grade.alias("grade"))
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).select("doc_id", grade.alias("grade"))
    model = quality.fit(docs, learned, 3)
    rows = quality.score(docs.join(held, "doc_id", "left_semi"), model, 3).join(held, "doc_id").collect()
    kept = {g: np.mean([r.p_ge_2 >= 0.5 for r in rows if r.grade == g]) for g in range(3)}
    # About a sixth of the toxic labels are on texts without any toxic word.
    assert kept[2] > 0.98 and kept[0] < 0.35 and kept[1] < 0.35
    by_grade = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert by_grade[0] < by_grade[2] and by_grade[1] < by_grade[2]
    assert all(0 <= r.p_ge_2 <= r.p_ge_1 <= 1 for r in rows)


def test_odd_rows(spark, make_docs):
    docs = make_docs(ODD, extra=True)
    grades = spark.createDataFrame([(1, 2), (2, 0), (2, 2), (3, 1), (None, 1), (8, None)], "doc_id long, grade int")
    model = quality.fit(docs, grades, 3)
    got = quality.score(docs, model, 3).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ODD) and all(r.expected_grade is not None for r in got)
    assert quality.fit(docs, grades.where("false"), 3) is None
    assert quality.score(docs, None, 3).where("expected_grade IS NULL").count() == len(ODD)
    assert quality.score(make_docs([]), model, 3).count() == 0
