import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazeflow.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """(cost, letters, repaired rows) over all edits of the rows, with up to two inserts in every gap. rows: (role, text, fault)."""
    found = []

    def edit(at, inserts, cost, letters, kept):
        pattern = "".join(r[:1] or " " for r, _ in kept)
        if not re.fullmatch("(s?(ua)*u?)", pattern):
            return  # nothing that follows makes it legal
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", pattern):
            found.append((cost, letters, kept))
        if inserts < 2:
            for role in ("user", "assistant"):
                edit(at, inserts + 1, cost + 2, letters + "I", [*kept, (role, "")])
        if at < len(rows):
            role, text, fault = rows[at]
            edit(at + 1, 0, cost + 3, letters + "D", kept)
            if fault not in ("b", "d"):
                more = int(fault == "t")
                edit(at + 1, 0, cost + more, letters + "K", [*kept, (role, text)])
                for other in ("user", "assistant"):
                    edit(at + 1, 0, cost + 2 + more, letters + "R", [*kept, (other, text)])

    edit(0, 0, 0, "", [])
    return min(found, key=lambda f: f[:2])


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def plain(rows):
    """Summaries of (conv_id, turn, role, text) rows, by brute force."""
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults = faults_of(own)
        cost, audit, kept = cheapest([(r, x, f) for (_, r, x), f in zip(own, faults)])
        turns = {t for t, *_ in own if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, "bdt"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest(),
        )
    return out


def found(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


ROWS = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Yes?"),
    (2, 0, "system", "Be brief."), (2, 1, "assistant", "Fine!"), (2, 4, "user", "no end"),
    (3, None, "user", None), (3, None, None, "one."), (3, 5, None, "one."),
    (4, 2, "user", "a."), (4, 2, "user", "a."), (4, 2, "assistant", "b."), (4, 3, "user", "a."),
    (5, 1, "tool", " \t\n"), (6, -3, "system", "only."), (7, 1, "Assistant", "capital."), (7, 9, "umpire", "kept. \t "),
    (None, 1, "assistant", "no id."), (None, 2, "assistant", "no id."), (8, 1, "", "\x1c"), (8, 2, "user", ""),
    (9, None, None, None), (9, -(2**63), "user", "x."), (9, 2**63 - 1, "assistant", "y"),
]


@pytest.mark.parametrize("chunk_rows", [1, 2, 256])
def test_equals_brute_force(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(cv, "CHUNK_ROWS", chunk_rows)
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("part", "seq", "audit", "n", "digest")})
    want = plain(ROWS)
    want[9] = (2**63 - 1, *want[9][1:])
    assert found(cv.summaries(rows.repartition(5))) == want


ENTRY = st.tuples(st.sampled_from("suax "), st.sampled_from("bdt--"))


@settings(max_examples=100, deadline=None)
@given(st.lists(ENTRY, max_size=4))
def test_weights_decide_cost_and_ties(entries):
    cost, audit, kept = cheapest([(c, "x", f) for c, f in entries])
    fold = cv.Fold()
    cuts = [entries] if entries else []
    fold_in(fold, cuts)
    assert walked(fold, cuts) == (cost, audit)


def fold_in(fold, chunks):
    for k, chunk in reversed(list(enumerate(chunks))):
        fold.add((k, 0), [m for row in cv.transfer([c for c, _ in chunk], "".join(f for _, f in chunk)) for m in row])


def walked(fold, chunks):
    cost, audit, state = 0, "", cv.START
    for (k, _), begin, end in fold.states():
        move = cv.transfer([c for c, _ in chunks[k]], "".join(f for _, f in chunks[k]))[begin][end]
        cost, audit, state = cost + move[0], audit + move[1], end
    return cost + 2 * len(cv.CLOSING[state]), audit + cv.CLOSING[state]


@settings(max_examples=300, deadline=None)
@given(st.lists(ENTRY, min_size=1, max_size=40), st.lists(st.integers(1, 39), max_size=6))
def test_chunks_join_to_the_whole(entries, cuts):
    cuts = [0, *sorted({c for c in cuts if c < len(entries)}), len(entries)]
    chunks = [entries[a:b] for a, b in zip(cuts, cuts[1:])]
    whole, split = cv.Fold(), cv.Fold()
    fold_in(whole, [entries])
    fold_in(split, chunks)
    assert walked(whole, [entries]) == walked(split, chunks)
    assert split.best[cv.START][0] == walked(split, chunks)[0]


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Yes."), (1, 1, "user", "no"), (1, 2, "user", "no")], SCHEMA)
    turns = [(r.role, r.text) for r in cv.repaired_turns(rows).orderBy("part", "seq", "place").collect()]
    _, audit, kept = cheapest([("assistant", "Yes.", "-"), ("user", "no", "t"), ("user", "no", "d")])
    assert turns == kept and audit == "IKDD"


def test_long_conversation_and_copies(spark, monkeypatch):
    """One conversation holds most rows, and one row of it comes a thousand times; chunks are small."""
    rows = [(1, i, ("user", "assistant", "system")[i * i % 3], f"text {i % 700}" + "." * (i % 2)) for i in range(2000)]
    rows += [(1, 5000, "user", "again.")] * 1000 + [(2, 0, "user", "x."), (3, None, "user", "long " * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole = found(cv.summaries(df))
    monkeypatch.setattr(cv, "CHUNK_ROWS", 64)
    monkeypatch.setattr(cv, "CHUNK_CHARS", 300)
    assert found(cv.summaries(df)) == whole
    own = sorted((r[1], r[2], r[3]) for r in rows[:3000])
    faults = faults_of(own)
    fold, chunk = cv.Fold(), [(r[1][:1], f) for r, f in zip(own, faults)]
    fold_in(fold, [chunk])
    assert whole[1][5:7] == walked(fold, [chunk]) and whole[1][1:4] == tuple(map(faults.count, "bdt"))
    assert whole[1][6].count("D") >= 999 and whole[3][5] == 3


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (*range(40), None) for t in (0, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "One Two" if kind == 2 else text)
            want += [row] * (2 if kind == 3 else 1)
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, cv.damaged(df).collect()), key=key) == sorted(want, key=key)
    assert found(cv.repair(cv.damaged(df), df)) == {c: (0, 0, 0, 0, 0, 0, "", EMPTY) for c, *_ in rows} | plain(want)


def test_ids_without_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(cv.summaries(none)) == {} and cv.repaired_turns(none).count() == 0
    ids = spark.createDataFrame([(1, 1, "user", "x.")] * 2 + [(None, 1, "user", "x.")], SCHEMA)
    assert found(cv.repair(none, ids)) == {1: (0, 0, 0, 0, 0, 0, "", EMPTY), None: (0, 0, 0, 0, 0, 0, "", EMPTY)}
