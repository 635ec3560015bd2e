"""Conversation structure repair (operator 13).

``damage`` breaks conversations in a fixed way, ``repair`` finds the cheapest
edits that make each one well formed: Keep (0), Rerole to user or assistant (1),
Delete (2), Insert an empty user or assistant turn (5); an undeleted truncated
row adds 5, a blank or duplicate row must go.  The initials of the roles left
must spell ``(s?(ua)+)?``.  Ties go to the edits whose initials are ASCII-least.

Both criteria are one scalar: a big integer whose high digits are the cost and
whose low digits, of fixed width, are the audit letters in order (D, I, K, R as
1 to 4, zero behind the last one).  The graph's nodes are (rows read, role state);
an edge is the Inserts before a row together with the row's own letter, its
weight the cost and those letters at the next free digits; the smallest integer
that reaches a node decides.  An edge always ends with a row's letter, so of two
strings that reach a node none begins the other, and their order cannot turn.

Spark damages the rows, groups them by conversation in one shuffle, finds
duplicates with a window and sorts by turn, all of which spill; Python reads the
sorted rows as a stream.  A conversation is worked off in blocks of at most
``BLOCK_ROWS`` rows: after a block each of the four states keeps its cost, the
rank of its letters, their text and a running SHA-256, so the integers and the
rows held stay short however long the conversation.  One conversation is one
task's stream, since its hash is sequential.

Edge cases: NULL roles and texts read as one space, as do NULL ids and turns
inside the damage key; all rows without id form one conversation; rows are taken
by turn, NULL first, equal turns by role and text as they were before damage, a
repeat right after its row; repeated input rows are duplicates of each other; an
empty role has no initial and is kept nowhere; a conversation without rows after
damage has zeros, an empty audit and the hash of nothing; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and bytes worked off at once.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
OK, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
_LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_PAIRS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_SPOKEN = {USER: b"user", ASSISTANT: b"assistant"}
_INITIAL = {b"s": SYSTEM, b"u": USER, b"a": ASSISTANT}
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTER = "\0DIKR"
_BITS = 3
_RULES = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, kind) with NULL roles and texts as one
    space; ``kind`` is the damage that ``damaged`` applies."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"),
        text_of("text").alias("text"), (F.crc32(key.cast("binary")) % 20).cast("int").alias("kind"))


def judged(rows: DataFrame) -> DataFrame:
    """Rows after damage, with their first fault, sorted inside partitions that
    hold whole conversations; a dropped row stays as a mark of its conversation."""
    kind = F.col("kind")
    # A dropped row's text need not travel.
    slim = rows.withColumn("text", F.when(kind == 0, F.lit("")).otherwise(F.col("text"))).repartition("conv_id")
    copies = slim.select("*", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    after = copies.select(
        "conv_id", "turn", F.col("role").alias("role0"), F.col("text").alias("text0"), "copy", (kind == 0).alias("dropped"),
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"))
    order = [F.asc_nulls_first("turn"), F.asc("role0"), F.asc("text0"), F.asc("copy")]
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(*order)) > 1
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    fault = F.when(last == "", BLANK).when(F.col("again"), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    return (after.withColumn("again", again).withColumn("fault", fault)
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), *order)
            .select("conv_id", "turn", "dropped", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "fault"))


def _next(state: int) -> int:
    """Role state that an inserted turn leads to; the pattern leaves one choice."""
    return ASSISTANT if state == USER else USER


def _edges(state: int, initial: int | None, fault: int) -> list[tuple[int, int, int, int]]:
    """(next state, cost, letters as digits, number of letters) for one row; of
    edges between the same two states only the least."""
    found = [(2, "D", state)]
    if fault in (OK, TRUNCATED):
        extra, at = (5 if fault == TRUNCATED else 0), state
        for inserts in range(3):
            if (at, initial) in _LEGAL:
                found.append((5 * inserts + extra, "I" * inserts + "K", initial))
            found.append((5 * inserts + 1 + extra, "I" * inserts + "R", _next(at)))
            at = _next(at)
    best: dict[int, tuple[int, str]] = {}
    for cost, letters, to in found:
        best[to] = min(best.get(to, (cost, letters)), (cost, letters))
    return [(to, cost, _digits(letters), len(letters)) for to, (cost, letters) in best.items()]


def _digits(letters: str) -> int:
    out = 0
    for c in letters:
        out = out << _BITS | _DIGIT[c]
    return out


_EDGES = {(s, i, f): _edges(s, i, f) for s in range(4) for i in (None, SYSTEM, USER, ASSISTANT) for f in range(4)}
#: Inserts that end a conversation well from each state.
_ENDING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


@dataclass(frozen=True)
class Path:
    """The best way to a state before the current block."""

    cost: int = 0
    rank: int = 0
    lines: int = 0
    hash: object = field(default_factory=hashlib.sha256)
    letters: tuple | None = None  # (letters of the last block, those before)


Row = tuple[bytes, bytes, int]  # role, text, fault


def _walk(path: Path, state: int, letters: str, rows: list[Row]) -> Path:
    """``path`` continued by the edits ``letters`` over ``rows``."""
    digest, lines, at = path.hash.copy(), path.lines, 0
    for c in letters:
        if c != "I":
            role, text, _ = rows[at]
            at += 1
        if c == "D":
            continue
        if c == "K":
            state, line = _INITIAL[role[:1]], role + b":" + text
        else:
            state = _next(state)
            line = _SPOKEN[state] + b":" + (text if c == "R" else b"")
        digest.update(b"\n" + line if lines else line)
        lines += 1
    return Path(path.cost, path.rank, lines, digest, (letters, path.letters))


def _advance(paths: dict[int, Path], rows: list[Row], ends: bool) -> dict[int, Path]:
    """Best paths after a block of rows; at the end, the one best path."""
    width = 3 * len(rows) + 3  # the rank, then at most three letters a row, two at the end
    top = _BITS * width
    # state -> (integer, digits used); digit 0 holds the rank of the path so far.
    values = {s: ((p.cost << top) + (p.rank << top - _BITS), 1) for s, p in paths.items()}
    for role, _, fault in rows:
        initial, reached = _INITIAL.get(role[:1]), {}
        for s, (value, used) in values.items():
            for to, cost, digits, n in _EDGES[s, initial, fault]:
                sum_ = value + (cost << top) + (digits << _BITS * (width - used - n))
                if to not in reached or sum_ < reached[to][0]:
                    reached[to] = (sum_, used + n)
        values = reached
    if ends:
        total = {s: v + (5 * len(_ENDING[s]) << top) + (_digits(_ENDING[s]) << _BITS * (width - used - len(_ENDING[s]))) for s, (v, used) in values.items()}
        least = min(total, key=total.get)
        values = {least: (total[least], 0)}
    by_rank = {p.rank: s for s, p in paths.items()}
    low = (1 << top) - 1
    order = sorted(values, key=lambda s: values[s][0] & low)
    out = {}
    for s, (value, _) in values.items():
        digits = [value >> _BITS * k & 7 for k in range(width - 1, -1, -1)]
        begin = by_rank[digits[0]]
        done = _walk(paths[begin], begin, "".join(_LETTER[d] for d in digits[1:] if d), rows)
        out[s] = Path(value >> top, order.index(s), done.lines, done.hash, done.letters)
    return out


def _audit(path: Path) -> str:
    parts, link = [], path.letters
    while link is not None:
        parts.append(link[0])
        link = link[1]
    return "".join(reversed(parts))


def repair_one(rows: Iterable[tuple[int | None, bytes, bytes, int]]) -> dict:
    """Result columns of one conversation from its (turn, role, text, fault) rows
    in order; holds one block of them."""
    count = [0, 0, 0, 0]
    first = last = None
    distinct = illegal = held_bytes = 0
    before: int | None = None
    any_row = False
    paths, held = {START: Path()}, []
    for turn, role, text, fault in rows:
        if len(held) >= BLOCK_ROWS or held_bytes > BLOCK_BYTES:
            paths, held, held_bytes = _advance(paths, held, False), [], 0
        held.append((role, text, fault))
        held_bytes += len(text)
        count[fault] += 1
        initial = _INITIAL.get(role[:1])
        illegal += any_row and (before, initial) not in _PAIRS
        before, any_row = initial, True
        if turn is not None:
            first = turn if first is None else first
            distinct += turn != last
            last = turn
    best = next(iter(_advance(paths, held, True).values()))
    return {"gaps": 0 if first is None else last - first + 1 - distinct, "blank": count[BLANK], "duplicate": count[DUPLICATE],
            "truncated": count[TRUNCATED], "illegal": int(illegal), "cost": best.cost, "audit": _audit(best),
            "repaired_sha256": best.hash.hexdigest()}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Result rows of a stream sorted by conversation."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    source = rows()
    ahead = next(source, None)

    def one(key) -> Iterator[tuple]:
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            _, turn, dropped, role, text, fault = ahead
            ahead = next(source, None)
            if not dropped:
                yield turn, role, text, fault

    while ahead is not None:
        key = ahead[0]
        yield {"conv_id": key, **repair_one(one(key))}


def repair(rows: DataFrame) -> DataFrame:
    """One row for every conversation of ``rows`` (see ``damage``): gaps, faults,
    cost, audit and hash of the repaired conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for row in _conversations(batches):
            out.append(row)
            if len(out) >= 2048:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return judged(rows).mapInArrow(run, _RULES)
