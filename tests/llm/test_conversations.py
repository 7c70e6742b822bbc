"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from shopledger.llm import conversations
from shopledger.llm.conversations import Tables, damaged, digests, repaired

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def cheapest(rows):
    """The least (cost, audit) with its lines, state by state; rows are (role, text, fault)."""
    def inserted(states):
        for _ in range(3):
            for q, (cost, audit, lines) in list(states.items()):
                to = NEXT[q, WANTED[q][0]]
                new = (cost + 3, audit + "I", lines + [WANTED[q] + ":"])
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    states = inserted({0: (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for q, (cost, audit, lines) in states.items():
            cut = 3 * (fault == "truncated")
            moves = [(q, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                if (q, role[:1]) in NEXT:
                    moves.append((NEXT[q, role[:1]], cut, "K", [f"{role}:{text}"]))
                moves.append((NEXT[q, WANTED[q][0]], 3 + cut, "R", [f"{WANTED[q]}:{text}"]))
            for to, more, edit, line in moves:
                new = (cost + more, audit + edit, lines + line)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        states = inserted(after)
    return min(states[q] for q in (0, 3) if q in states)


def plain(rows, damage):
    by_conv = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = by_conv.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept.extend([(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3)))
    out = {}
    for conv, kept in by_conv.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0], r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in kept:
            visible = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit, lines = cheapest(marked)
        count = lambda f: sum(m[2] == f for m in marked)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows, damage=False, extra=False, **parameters):
    df = spark.createDataFrame([r + (("x",) * 3 if extra else ()) for r in rows], SCHEMA + ", piece string, kind string, symbol string" * extra)
    df = repaired(damaged(df), "present", **parameters) if damage else repaired(df, **parameters)
    assert df.columns[:3] == ["conv_id", "piece", "pieces"]
    out = digests(df)
    assert out.columns == NAMES
    rows = [tuple(r) for r in out.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def drawn(seed, conversations=60, turns=11):
    draw = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(draw.randrange(turns)):
            role = draw.choice(["user", "assistant"] * 4 + ["system", "tool", "User", "", None, "s"])
            text = draw.choice([f"{turn}.", "hi!", "what? ", "cut", "é", " \t\n", "", None, "End.\x0b", " ."])
            rows.append((conv if conv else None, draw.choice([turn, turn, turn, turn * 2, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("damage", [False, True])
def test_equals_plain_search(spark, seed, damage):
    rows = drawn(seed)
    assert found(spark, rows, damage) == plain(rows, damage)


def test_pieces_give_the_same(spark):
    rows = drawn(3, 12, 40)
    expected = plain(rows, True)
    assert found(spark, rows, True, piece_chars=300) == expected
    assert found(spark, rows, True, extra=True, piece_chars=1) == expected


def test_one_conversation_over_all_tasks(spark):
    rows = [(7, i // 3, ("user", "assistant", "user")[i % 3], f"{i % 900}." if i % 5 else "cut") for i in range(4000)]
    rows += [(7, None, "user", "same.")] * 500 + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    out = repaired(spark.createDataFrame(rows, SCHEMA), piece_chars=20_000)
    assert out.where("conv_id = 7").count() > 8
    assert {r[0]: tuple(r)[1:] for r in digests(out).collect()} == plain(rows, False)


def test_edges(spark):
    assert found(spark, []) == {}
    dropped = next((c, t) for c in range(100) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = [(*dropped, "user", "Gone."), (500, None, None, None), (501, 1, "user", "x" * 3_000_000 + "."), (501, 2, "assistant", "y.")]
    out = found(spark, rows, True, piece_chars=1_000_000)
    assert out == plain(rows, True)
    assert out[dropped[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("block", [1, 2, 3])
def test_block_length_changes_nothing(block, spark):
    draw, known = random.Random(block), conversations.tables()
    other = Tables(block)
    for _ in range(200):
        symbols = bytes(draw.randrange(9) for _ in range(draw.randrange(12)))
        for vector, values in enumerate(known.vectors):
            assert other.vectors[vector] == values
        assert other.trace(symbols, 0, range(4)) == known.trace(symbols, 0, range(4))
