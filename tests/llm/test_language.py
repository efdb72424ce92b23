import itertools
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hazeflow.llm import language

from .conftest import ODD


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    moves = rng.standard_normal((3, 3))
    lengths = np.array([1, 4, 6])
    log_w = rng.standard_normal((lengths.sum(), 3))
    got, at = language.marginals(log_w, lengths, moves), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            start = np.logaddexp.reduce(moves[:, path[0]])
            weight = np.exp(start + sum(log_w[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += weight
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_blocks_equal_one_chain(monkeypatch):
    rng = np.random.default_rng(1)
    moves, lengths = rng.standard_normal((4, 4)), np.array([1, 31, 32, 33, 500, 64, 2])
    log_w = 3 * rng.standard_normal((lengths.sum(), 4))
    got = language.marginals(log_w, lengths, moves)
    monkeypatch.setattr(language, "BLOCK", 512)
    assert np.allclose(got, language.marginals(log_w, lengths, moves))


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(2)
    docs = [(0, "the house and the tree near a river".split() * 5), (1, "das haus und der baum am fluss".split() * 5)]
    sequences, gold = language.code_switched(docs, rng)
    zero = language.Model(["en", "de"], {}, np.zeros((language.DIM, 2)), np.zeros((3, 2)), np.zeros((2, 2)))
    fitted = language.Model(["en", "de"], {}, *language.local_fit(zero, sequences[:200], gold[:200], 20))
    found = language.Tagger(fitted).tag([" ".join(s) for s in sequences[200:260]])
    assert np.mean([f.argmax(axis=1) == g for f, g in zip(found, gold[200:260])]) > 0.98


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs, ~language.held_out())
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(out) > 200 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    mixed = spark.createDataFrame([(1, docs.where("lang = 'de'").first().text[:200] + " " + docs.where("lang = 'es'").first().text[:200])], "doc_id long, text string")
    spans = language.spans(mixed, model).first().spans
    assert spans[0].lang == "de" and spans[-1].lang == "es" and sum(s.n for s in spans) == len(language.words_of(mixed.first().text))


def test_odd_rows(make_docs):
    docs = make_docs(ODD, extra=True)
    model = language.fit(docs, F.lit(True))
    got = language.predict(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ODD)
    assert all((r.lang_pred == "und" and r.score == 0) == (r.doc_id in (3, 4, 5) or (r.doc_id is None and r.score == 0)) for r in got)
    kept = language.recognised(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id IN (3, 4, 5)").count() == 0
    empty = make_docs([])
    assert language.fit(empty, F.lit(True)) is None and language.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_numerals_are_no_letters(make_docs):
    assert language.words_of("½ ② ³ Ⅷ 12 _ ٣") == [] and language.words_of("ab½cd x² Ünï_ö") == ["ab", "cd", "x", "ünï", "ö"]
    model = language.fit(make_docs(ODD), F.lit(True))
    rows = language.predict(make_docs([(1, "½ ② ³"), (2, "tie ½")]), model).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows}[1] == ("und", 0.0) and {r.doc_id: r.lang_pred for r in rows}[2] != "und"


def test_training_words_come_from_the_whole_text(make_docs):
    words = [str(i) for i in range(12_345)]
    got = language.spread(words)
    assert language.spread(words[:400]) == words[:400] and len(got) == language.SAMPLE_WORDS and got[0] == "0" and got[-1] == "12344"
    assert max(int(b) - int(a) for a, b in zip(got, got[1:])) < 12_345 / 39 and len(set(got)) == len(got)
    assert len(language.spread(words[:405])) == 400
    # The language of a text that begins with 500 foreign words is learned from what follows.
    en, de = "the house and tree near river ", "das haus und baum am fluss "
    docs = make_docs([(i, en * 100 + de * 900, "de") for i in range(8)] + [(i, en * 50, "en") for i in range(8, 16)])
    model = language.fit(docs.select("doc_id", "text", "lang"), F.lit(True))
    assert "haus" in model.lexicon and language.fit(docs, F.lit(True), most_labels=1).labels == ["de"]


def test_memory_of_a_tagging_task_is_bounded():
    """A batch of texts is tagged in stretches: new words and word weights of all of it never stand in memory together."""
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, 8))) for _ in range(2500)) for _ in range(120)]
    model = language.Model(list("abcd"), {}, rng.standard_normal((language.DIM, 4)), np.zeros((5, 4)), np.zeros((4, 4)))
    tracemalloc.start()
    labels, scores = language._predicted(language.Tagger(model), pa.array([*texts, None]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(labels) == 121 and (labels[-1], scores[-1]) == ("und", 0.0)
    alone = [language._predicted(language.Tagger(model), pa.array([t])) for t in texts[::40]]
    assert [x[0][0] for x in alone] == labels[:-1:40] and np.allclose([x[1][0] for x in alone], scores[:-1:40])
