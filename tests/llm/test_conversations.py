"""Conversation repair against plain search over edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from prospect.llm import conversations as C

pytestmark = pytest.mark.filterwarnings("ignore")
SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"(s?(ua)+)?")
SPOKEN = {"u": "user", "a": "assistant"}


def edits_of(role, text, fault):
    yield "D", 2, None
    if fault in (C.OK, C.TRUNCATED):
        more = 5 if fault == C.TRUNCATED else 0
        yield "K", more, (role, text)
        for r in ("user", "assistant"):
            yield "R", 1 + more, (r, text)


def spelled(lines):
    return "".join(r[:1] or "?" for r, _ in lines)


def digest(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def every_edit(rows):
    """The least (cost, audit) over all edits with up to two inserts in a gap."""
    gaps = [g for k in range(3) for g in itertools.product("ua", repeat=k)]
    best = None
    for combo in itertools.product(*([(g, e) for g in gaps for e in edits_of(*row)] for row in rows), gaps):
        cost, audit, lines = 0, "", []
        for gap, edit in [*combo[:-1], (combo[-1], None)]:
            cost, audit, lines = cost + 5 * len(gap), audit + "I" * len(gap), lines + [(SPOKEN[x], "") for x in gap]
            if edit:
                cost, audit, lines = cost + edit[1], audit + edit[0], lines + ([edit[2]] if edit[2] else [])
        if (best is None or (cost, audit) < best[:2]) and PATTERN.fullmatch(spelled(lines)):
            best = (cost, audit, digest(lines))
    return best


def best_first(rows):
    """The same by best-first search; states are rows read and the role states
    that a prefix of the pattern allows."""
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, lines = heapq.heappop(heap)
        roles = spelled(lines)
        if (at, roles[-1:]) in seen or not (re.fullmatch(r"(s?(ua)*u?)?", roles)):
            continue
        if at == len(rows) and PATTERN.fullmatch(roles):
            return cost, audit, digest(lines)
        if at < len(rows):
            for letter, more, line in edits_of(*rows[at]):
                heapq.heappush(heap, (cost + more, audit + letter, at + 1, (*lines, line) if line else lines))
        if not audit.endswith("III"):
            for r in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, audit + "I", at, (*lines, (r, ""))))
        if not audit.endswith("I"):
            seen.add((at, roles[-1:]))
    raise AssertionError


def after_damage(rows):
    """The contract's damage over (conv_id, turn, role, text) rows of one conversation."""
    out = []
    text_of = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, text_of(r[2]).encode(), text_of(r[3]).encode())):
        role, text, kind = text_of(role), text_of(text), zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def expected(rows, search):
    rows, seen, judged, count, illegal, before = after_damage(rows), set(), [], [0] * 4, 0, None
    for _, role, text in rows:
        seen_text = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = C.BLANK if not seen_text else C.DUPLICATE if (role, text) in seen else C.TRUNCATED if seen_text[-1] not in ".!?" else C.OK
        seen.add((role, text))
        judged.append((role, text, fault))
        count[fault] += 1
        illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, count[C.BLANK], count[C.DUPLICATE], count[C.TRUNCATED], illegal, *search(judged))


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in C.repair(C.damage(df)).collect()}


@pytest.mark.parametrize("block", [512, 2, 1])
def test_every_small_conversation_equals_all_edits(monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    rng = random.Random(block)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "user", "assistant", " ", "", "tool"]), rng.choice("abc"), rng.choice([0, 0, 0, 1, 2, 3]))
                for _ in range(rng.choice([0, 1, 2, 2, 3]))]
        r = C.repair_one((k, role.encode(), text.encode(), fault) for k, (role, text, fault) in enumerate(rows))
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == every_edit(rows), rows


def test_blocks_do_not_change_a_long_conversation(monkeypatch):
    rng = random.Random(3)
    rows = [(k, rng.choice([b"user", b"assistant", b"system", b" "]), b"x", rng.choice([0, 0, 0, 1, 2, 3])) for k in range(1500)]
    results = set()
    for block in (1, 7, 512, 5000):
        monkeypatch.setattr(C, "BLOCK_ROWS", block)
        results.add(tuple(C.repair_one(iter(rows)).values()))
    assert len(results) == 1


def test_the_whole_table_equals_best_first_search(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    by_conv = {}
    for r in df.collect():
        by_conv.setdefault(r["conv_id"], []).append((r["conv_id"], r["turn"], r["role"], r["text"]))
    assert got(df) == {k: expected(v, best_first) for k, v in by_conv.items()}


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3, 4) for t, r, x in
            [(None, "user", "Hi."), (None, None, None), (3, "assistant", "Yes."), (3, "assistant", "Yes."), (3, "Assistant", "no"), (5, "", "Go!"), (5, "user", "")]]
    rows += [(9, None, None, None)] + [(c, 0, "user", "Gone.") for c in range(100, 160)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS kind", "2 AS copy", "3 AS fault")
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    result = got(df)
    assert result == {k: expected(v, best_first) for k, v in by_conv.items()}
    gone = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert gone in result.values()  # a conversation whose only row was dropped
    assert C.repair(C.damage(df.limit(0))).count() == 0


def test_a_long_text_and_a_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(3000)] + [(2, 0, "user", "word " * 200_000 + "."), (2, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    result = got(df)
    assert len(result) == 2 and len(result[1][6]) >= 2500
    assert result[2] == expected(rows[-2:], best_first)
