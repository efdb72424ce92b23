"""The stages, one after the other, against plain forms of them."""

import corpus_pipeline
from hazeflow.llm import language

from . import test_decontamination, test_mixing, test_simhash

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages_equal_plain_forms(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "simhash_dedup", "decontamination", "mixing", "sharding"]

    known = stage["language_id"](spark, docs, SF).cache()
    predicted = language.predict(docs, language.fit(docs, ~language.held_out())).collect()
    assert {r[0] for r in rows_of(known)} == {r.doc_id for r in predicted if r.lang_pred != "und" and r.score >= 0.5}
    assert known.count() > 0.97 * docs.count()

    single = stage["simhash_dedup"](spark, known, SF).cache()
    rows = rows_of(known)
    groups = {}
    for r, root in zip(rows, test_simhash.plain_components([test_simhash.plain_fingerprint(r[1]) for r in rows])):
        groups.setdefault(root, []).append(r[0])
    assert sorted(r[0] for r in rows_of(single)) == sorted(min(g) for g in groups.values())

    clean = stage["decontamination"](spark, single, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, *_ in test_decontamination.plain(rows_of(single), items)}
    assert leaked and sorted(r[0] for r in rows_of(clean)) == sorted(r[0] for r in rows_of(single) if r[0] not in leaked)

    mixed = stage["mixing"](spark, clean, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = {r.doc_id: max(x.quality for x in labels if x.doc_id == r.doc_id) for r in labels}
    want = test_mixing.plain(rows_of(clean), {d: 2.0 if q > 0 else 0.5 for d, q in good.items()})
    taken = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert taken == {d: t // n for d, n, _, _, t in want if n and t}

    final = stage["sharding"](spark, mixed, SF)
    assert final.columns == [*docs.columns, "shard"] and all(f.columns == docs.columns for f in (known, single, clean, mixed))
    out = sorted((r.doc_id, r.shard) for r in final.collect())
    assert [d for d, _ in out] == sorted(r[0] for r in rows_of(mixed)) and {s for _, s in out} == set(range(16))
    assert len(set(out)) == len({d for d, _ in out})  # repeats of a document stay together
    assert sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, SF).collect()) == out


def test_odd_rows_and_empty_tables(spark, make_docs):
    from .conftest import ODD

    for docs in (make_docs(ODD, extra=True).drop("shard"), make_docs([])):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).cache()
            assert docs.columns == (columns if name != "sharding" else [*columns, "shard"])
        assert docs.where("text IS NULL").count() == 0
