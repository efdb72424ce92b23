"""Repair of conversation structure: the cheapest edits that make roles read system?, (user, assistant)+.

Edits of a row are K(eep) 0, R(erole to user or assistant) 2 and D(elete) 3; I(nsert an empty user or assistant row) costs 2 anywhere.
Blank and repeated rows have to go, and a truncated row that stays costs 1 more. Of the cheapest
repairs the one whose letters, in order, are least in ASCII is taken.

One integer weighs a path. Its high digits are the cost. The low ones have a fixed width: a byte per letter from the left, zeros
behind the last. So the ordinary minimum of integers decides cost and ties at once, over a graph whose nodes are
(row, state of the role pattern). Equally cheap letters for the same rows and states never begin with one another, because every
letter beyond the rows is an insert and costs: minima of stretches therefore join to the minimum of the whole.

That splits long conversations. Rows are dealt out by ranges of (conversation, turn) and cut into chunks of at most
``CHUNK_ROWS`` rows; a chunk's 4 x 4 weights, from each state at its beginning to each at its end, are found where it lies. A fold over the
chunks of a conversation, without their texts, picks the states between chunks; the chunks' letters follow. Only the hash of a repaired
conversation, and its letters, pass through one task in order: they are single values of it.

Rows of a conversation stand in order of turn (nulls first), of equal turns by role, then by a digest of role and text. Exact
copies are counted before they are moved, and then dealt in stretches.

Defined results. Null role or text: one space, so such a text is blank. Null turns: first, and no part of gaps. Null conversation id: a conversation like
any other. Roles that begin with none of s, u, a (capitals too): no place in the pattern. Repeated rows: repeats. No rows: nothing, and for an id without rows
zeros, no letters and the hash of the empty string. Empty table: no rows. Columns other than conv_id, turn, role, text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeflow.session import materialize

from .base import parts

CHUNK_ROWS = 256
CHUNK_CHARS = 1 << 20
SPACE = " \t\n\r\x0b\x0c"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, TRUNCATED, SOUND = "bdt-"

# States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
START, STATES = 0, range(4)
MOVES = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The role, and the state after it, that an insert or a new role gives in each state.
GIVEN = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
#: Inserts that complete the pattern at the end of a conversation.
CLOSING = ["", "II", "I", ""]
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
DIGIT = 8

LONG_MOST = (1 << 63) - 1

CHUNK = (
    "conv_id long, part int, seq int, turns array<long>, roles array<string>, texts array<string>, faults string, moves array<string>"
)
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def transfer(initials: list[str], faults: str) -> list[list[tuple[int, str] | None]]:
    """[from][to] -> (cost, letters) of the cheapest edits of the rows, or None; inserts stand before rows only."""
    low = DIGIT * 3 * len(faults)  # two inserts and its own letter for every row
    top, digits, never = low - DIGIT, (1 << low) - 1, 1 << (low + 64)

    def before(letter: str, cost: int, weight: int) -> int:
        rest = weight & digits
        return weight - rest + (cost << low) + (ord(letter) << top) + (rest >> DIGIT)

    ends = []
    for end in STATES:
        best = [never] * 4
        best[end] = 0
        for c, fault in zip(reversed(initials), reversed(faults)):
            row = []
            for s in STATES:
                weight = before("D", DELETE, best[s])
                if fault not in (BLANK, DUPLICATE):
                    more = LEFT_TRUNCATED * (fault == TRUNCATED)
                    weight = min(weight, before("R", REROLE + more, best[GIVEN[s][1]]))
                    if c in MOVES[s]:
                        weight = min(weight, before("K", more, best[MOVES[s][c]]))
                row.append(weight)
            best = row
            for _ in range(2):  # more inserts would come back to a state that costs less
                best = [min(row[s], before("I", INSERT, best[GIVEN[s][1]])) for s in STATES]
        ends.append(best)
    read = lambda w: (w >> low, (w & digits).to_bytes(low // DIGIT, "big").rstrip(b"\0").decode()) if w < never else None
    return [[read(ends[end][s]) for end in STATES] for s in STATES]


def _scalar(cost: int, letters: str, width: int) -> int:
    return (cost << DIGIT * width) | int.from_bytes(letters.encode().ljust(width, b"\0"), "big")


class Fold:
    """States between the chunks of one conversation; chunks are added from the last to the first."""

    def __init__(self) -> None:
        # Cost and letters to the end from each state; letters that all states share are dropped.
        self.best: list[tuple[int, str] | None] = [(INSERT * len(x), x) for x in CLOSING]
        self.next: list[tuple[tuple, tuple[int, ...]]] = []

    def add(self, key: tuple, moves: list[tuple[int, str] | None]) -> None:
        found, then = [], []
        for s in STATES:
            paths = [
                (move[0] + rest[0], move[1] + rest[1], end)
                for end, (move, rest) in enumerate(zip(moves[4 * s : 4 * s + 4], self.best))
                if move is not None and rest is not None
            ]
            width = max((len(x) for _, x, _ in paths), default=0)
            least = min(paths, key=lambda x: _scalar(x[0], x[1], width), default=None)
            found.append(None if least is None else least[:2])
            then.append(-1 if least is None else least[2])
        if len({t for t in then if t >= 0}) == 1:
            found = [f and (f[0], moves[4 * s + then[s]][1]) for s, f in enumerate(found)]
        self.best = found
        self.next.append((key, tuple(then)))

    def states(self) -> Iterator[tuple[tuple, int, int]]:
        """(chunk, state at its beginning, state at its end), from the first chunk on."""
        at = START
        for key, then in reversed(self.next):
            yield key, at, then[at]
            at = then[at]


def repaired(roles: list[str], texts: list[str], letters: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the letters give, from a state on."""
    row = iter(zip(roles, texts))
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(row)
        if letter == "D":
            continue
        if letter == "K":
            state = MOVES[state][role[:1]]
        else:
            role, state = GIVEN[state]
        yield role, text


def _fault(text: str, first: bool) -> str:
    shown = text.strip(SPACE)
    if not shown:
        return BLANK
    return DUPLICATE if not first else SOUND if shown[-1] in ENDS else TRUNCATED


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults: by a hash of conversation and turn a row goes, loses its text or its ends, comes twice, or speaks as the user."""
    blank = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")
    ).where("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    once_or_twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), once_or_twice.alias("_copy")).drop("_copy")


def _dealt(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, and whether an earlier turn has the same role and text; in order, by ranges."""
    spark = rows.sparkSession
    blank = F.lit(" ")
    own = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role"), blank).alias("role"), F.coalesce(F.col("text"), blank).alias("text")
    )
    counted = own.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    counted = materialize(counted.withColumn("digest", digest), "conversation-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0).cast("bigint")).alias("turn"))
    again = counted.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    same = counted["conv_id"].eqNullSafe(again["_conv"]) & (counted["digest"] == again["_digest"])
    marked = counted.join(again, same, "left").withColumn("earliest", F.col("first").isNull() | (F.col("first") == place))
    stretches = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.lit(CHUNK_ROWS))))
    dealt = marked.select("conv_id", "turn", "role", "text", "digest", "n", "earliest", stretches.alias("stretch")).select(
        "conv_id", "turn", "role", "text", "digest", "stretch",
        F.least(F.lit(CHUNK_ROWS).cast("bigint"), F.col("n") - F.col("stretch") * CHUNK_ROWS).cast("int").alias("copies"),
        (F.col("earliest") & (F.col("stretch") == 0)).alias("first"),
    )
    order = ["conv_id", "turn", "role", "digest", "stretch"]
    return dealt.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).drop("digest", "stretch")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from batch.slice(at, 1024).to_pylist()


def _written(rows: Iterator[dict], schema: str, most: int = 512, chars: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, few enough for their texts."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row.get("texts") or ())) + len(row.get("audit") or "")
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=arrow)


def _chunks(rows: DataFrame) -> DataFrame:
    """Chunks of consecutive rows of a conversation with their faults and weights, written."""

    def cut(conv_id: int | None, own: Iterator[dict]) -> Iterator[dict]:
        turns, roles, texts, faults, chars = [], [], [], [], 0

        def chunk() -> dict:
            moves = [f"{m[0]}:{m[1]}" if m else None for row in transfer([r[:1] for r in roles], "".join(faults)) for m in row]
            return {"conv_id": conv_id, "turns": turns, "roles": roles, "texts": texts, "faults": "".join(faults), "moves": moves}

        for r in own:
            for k in range(r["copies"]):
                fault = _fault(r["text"], r["first"] and k == 0)
                text = "" if fault in (BLANK, DUPLICATE) else r["text"]  # they go in any case
                if turns and (len(turns) >= CHUNK_ROWS or chars + len(text) > CHUNK_CHARS):
                    yield chunk()
                    turns, roles, texts, faults, chars = [], [], [], [], 0
                turns.append(r["turn"])
                roles.append(r["role"])
                texts.append(text)
                faults.append(fault)
                chars += len(text)
        yield chunk()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        runs = groupby(_rows(batches), key=lambda r: r["conv_id"])
        chunks = (c for conv_id, own in runs for c in cut(conv_id, own))
        yield from _written(({**c, "part": part, "seq": k} for k, c in enumerate(chunks)), CHUNK)

    return materialize(_dealt(rows).mapInArrow(run, CHUNK), "conversation-chunks")


def _in_order(chunks: DataFrame, descending: bool = False) -> DataFrame:
    """A conversation's chunks in one task, in order."""
    order = [F.col("part"), F.col("seq")]
    return chunks.repartition(parts(chunks.sparkSession), "conv_id").sortWithinPartitions("conv_id", *[c.desc() if descending else c for c in order])


def _decided(chunks: DataFrame) -> DataFrame:
    """The chunks with the letters and the state at the beginning that the fold gives them."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decisions() -> Iterator[dict]:
            for _, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
                f, k = Fold(), 0
                for r in own:
                    f.add((r["part"], r["seq"]), [m and (int(m.split(":")[0]), m.split(":")[1]) for m in r["moves"]])
                for k, ((part, seq), begin, end) in enumerate(f.states(), 1):
                    yield {"part": part, "seq": seq, "begin": begin, "end": end, "last": int(k == len(f.next))}

        yield from _written(decisions(), states, most=4096)

    states = "part int, seq int, begin int, end int, last int"
    decided = _in_order(chunks.select("conv_id", "part", "seq", "moves"), descending=True).mapInArrow(fold, states)
    both = chunks.join(decided, ["part", "seq"])
    move = F.split(F.element_at("moves", F.col("begin") * 4 + F.col("end") + 1), ":")
    closing = F.when(F.col("last") == 1, F.element_at(F.array(*map(F.lit, CLOSING)), F.col("end") + 1)).otherwise(F.lit(""))
    return both.select(
        "conv_id", "part", "seq", "turns", "roles", "texts", "faults", "begin",
        F.concat(move[1], closing).alias("audit"), (move[0].cast("bigint") + F.length(closing) * INSERT).alias("cost"),
    )


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, part, seq, place (their order) and role, text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[dict]:
            for r in _rows(batches):
                for place, (role, text) in enumerate(repaired(r["roles"], r["texts"], r["audit"], r["begin"])):
                    yield {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "place": place, "role": role, "text": text}

        yield from _written(given(), turns)

    turns = "conv_id long, part int, seq int, place int, role string, text string"
    return _decided(_chunks(rows)).mapInArrow(run, turns)


def summaries(rows: DataFrame) -> DataFrame:
    """One row per conversation that has rows: its faults, the cost and letters of its repair, and the hash of the repaired ``role:text`` lines."""

    def summary(conv_id: int | None, chunks: Iterator[dict]) -> dict:
        digest, audit, line_end, before, begun = hashlib.sha256(), [], "", "", False
        count, known, cost, illegal = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED, SOUND), 0), None, 0, 0
        for r in chunks:
            for fault in count:
                count[fault] += r["faults"].count(fault)
            for role in r["roles"]:
                illegal += begun and before + role[:1] not in LEGAL
                before, begun = role[:1], True
            for turn in r["turns"]:  # in order
                if turn is not None and (known is None or turn != known[1]):
                    known = (turn, turn, 1) if known is None else (known[0], turn, known[2] + 1)
            for role, text in repaired(r["roles"], r["texts"], r["audit"], r["begin"]):
                digest.update(f"{line_end}{role}:{text}".encode())
                line_end = "\n"
            audit.append(r["audit"])
            cost += r["cost"]
        gaps = min(LONG_MOST, known[1] - known[0] + 1 - known[2]) if known else 0
        return {
            "conv_id": conv_id, "gaps": gaps, "blank": count[BLANK], "duplicate": count[DUPLICATE], "truncated": count[TRUNCATED],
            "illegal": illegal, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = groupby(_rows(batches), key=lambda r: r["conv_id"])
        yield from _written((summary(c, own) for c, own in runs), SUMMARY)

    return _in_order(_decided(_chunks(rows))).mapInArrow(run, SUMMARY)


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``summaries`` of the rows, with a row for every conv_id of ``ids``."""
    every = ids.select(F.col("conv_id").cast("bigint").alias("_conv")).distinct()
    joined = every.join(summaries(rows), F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        F.col("_conv").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
