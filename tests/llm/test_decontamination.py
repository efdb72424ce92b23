import random
import re

from hazeflow.llm import decontamination

from .conftest import ODD


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(rows, items):
    out = []
    for item_id, text in set(items):
        own = words(text)
        k = min(5, len(own))
        of_item = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for r in rows:
            w = words(r[1])
            shared = len(of_item & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) if own else 0
            if own and shared >= 0.8 * len(of_item) - 1e-9:
                out.append((r[0], item_id, shared, len(of_item)))
    return sorted(out, key=str)


def check(spark, docs, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontamination.leaks(docs, benchmark).collect()), key=str)
    assert got == plain(rows, items)
    return got


def corpus():
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice((1, 3, 5, 6, 9, 20, 40, 80, 200))))) for i in range(60)]
    rows = []
    for d in range(120):
        text = [word() for _ in range(rnd.choice((2, 30, 300, 4000)))]
        if d % 2:
            leak = items[rnd.randrange(60)][1].split()
            for _ in range(rnd.randrange(4)):
                leak[rnd.randrange(len(leak))] = word()
            half, at = len(leak) // 2, rnd.randrange(len(text))
            text[at:at] = leak if d % 4 == 1 else leak[:half] + [word()] + leak[half:]
        rows.append((d, ", ".join(text).upper() if d % 3 else " ".join(text)))
    return rows, items


def test_equals_plain_form(spark, make_docs, monkeypatch):
    rows, items = corpus()
    assert len(check(spark, make_docs(rows), rows, items)) > 20
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 2000)
    check(spark, make_docs(rows), rows, items)


def test_odd_rows(spark, make_docs):
    items = [(1, "one two three four five six"), (1, "one two three four five six"), (2, "tie"), (3, None), (4, ""), (None, "long long long long long")]
    docs = make_docs(ODD, extra=True)
    check(spark, docs, ODD, items)
    check(spark, make_docs([]), [], items)
    check(spark, docs, ODD, [])
    out = decontamination.clean_documents(docs, spark.createDataFrame(items, "item_id long, text string"))
    leaked = {d for d, *_ in plain(ODD, items)}
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in ODD if r[0] not in leaked)
