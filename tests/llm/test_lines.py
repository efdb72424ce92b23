import random

import pytest

from hazeflow.llm import lines

from .conftest import ODD


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain(rows, edits):
    places, docs = [], {}
    for d, text, *_ in rows:
        docs.setdefault(d, [0, 0, 0, 0])
        for p, raw in enumerate((text or "").split("\n")):
            if line := raw.strip(lines.BLANKS):
                places.append(((d is not None, d or 0, p), d, line))
    first = {}
    for at, _, line in places:
        first[line] = min(at, first.get(line, at))
    for at, d, line in places:
        n = docs[d]
        n[0] += 1
        if at != first[line]:
            n[1] += 1
        elif any(
            o < at and 0 < distance(line, other) <= min(edits, min(len(line), len(other)) // lines.CHARS_PER_EDIT)
            for other, o in first.items() if abs(len(other) - len(line)) <= edits
        ):
            n[2] += 1
        else:
            n[3] += len(line.encode())
    return {d: tuple(n) for d, n in docs.items()}


def corpus(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé ü") for _ in range(rnd.choice((5, 19, 20, 21, 39, 40, 41, 60, 90)))) for _ in range(25)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rnd.randrange(1, 7)):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
                at = rnd.randrange(len(line))
                line[at : at + rnd.randrange(2)] = [rnd.choice("abé üx")] * rnd.randrange(2)
            text.append("".join(line))
        rows.append((d, "\n".join(text)))
    return rows


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_equals_plain_form(make_docs, edits):
    rows = corpus(edits)
    got = {r.doc_id: (r.n_lines, r.n_repeated, r.n_near, r.kept_bytes) for r in lines.line_counts(make_docs(rows), edits).collect()}
    assert got == plain(rows, edits) and sum(x[2] for x in got.values()) > 10


def test_odd_rows(make_docs):
    rows = [*ODD, (20, "a line of some twenty characters\n\n a line of some twenty characterz \nshort\nshort"), (21, "y" * 900 + "\n" + "y" * 899)]
    got = {r.doc_id: (r.n_lines, r.n_repeated, r.n_near, r.kept_bytes) for r in lines.line_counts(make_docs(rows, extra=True)).collect()}
    assert got == plain(rows, 1)
    assert lines.line_counts(make_docs([])).count() == 0


def test_cleaned_text(make_docs):
    rows = [(1, "a line of some twenty characters\nb\n\nb"), (2, "a line of some twenty charactersz\nc"), (3, None)]
    assert {r.doc_id: r.text for r in lines.cleaned(make_docs(rows)).collect()} == {1: "a line of some twenty characters\nb", 2: "c", 3: ""}


def test_no_python_in_the_plan(make_docs):
    plan = lines.line_counts(make_docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
