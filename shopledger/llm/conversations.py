"""Cheapest repair of conversations to ``(system? (user assistant)+)?``, by tables of symbol blocks.

A turn is a symbol: one that must go, or a role initial (s, u, a, other) that is cut short or not. The grammar has four
states, so what is left to pay at a place is a vector of four costs. Less its smallest entry it is one of a few dozen
vectors, because any state reaches another by a few edits. In the manner of the Four Russians (Arlazarov, Dinic,
Kronrod and Faradzev, 1970) the change of the vector over every block of four symbols is computed once, for every
vector; conversations are then read block by block from their end. The edits follow from the beginning: each block is
expanded backward from the vector at its right, and of the edits that keep the cost the ASCII-least is taken.

Conversations are sorted over the cluster by id and turn. One that lies inside a task is repaired there. One that
crosses tasks, or a bound of size, is cut into pieces: a piece is a map from vectors to vectors and from states to
states, and only those maps meet in one place, so one conversation may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import written

KEEP_CUT, REROLE, DELETE, INSERT = 3, 3, 4, 3
BLOCK, SYMBOLS = 4, 9
INITIALS = "sua"
#: By state (begin, after system, after user, after assistant): the state after each kept initial, and the role that an
#: inserted or changed turn takes there with the state after it.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
END = (0, 2 * INSERT, INSERT, 0)
BLANKS = " \t\n\x0b\f\r"


def before(after: Sequence[int], symbol: int) -> list[int]:
    """What is left to pay in each state before ``symbol``, from what is left after it."""
    role, cut = "sua?"[(symbol - 1) % 4] if symbol else "", KEEP_CUT * (symbol > 4)
    costs = []
    for state in range(4):
        least = DELETE + after[state]
        if symbol:
            least = min(least, REROLE + cut + after[WANTED[state][1]])
            if role in KEPT[state]:
                least = min(least, cut + after[KEPT[state][role]])
        costs.append(least)
    for _ in range(3):
        costs = [min(cost, INSERT + costs[WANTED[state][1]]) for state, cost in enumerate(costs)]
    return costs


class Tables:
    """The vectors, and by block length the vector before each block and its cost, for every vector after it."""

    def __init__(self, block: int = BLOCK):
        self.block, self.vectors, number = block, [END], {END: 0}
        one = []
        for vector in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                costs = before(vector, symbol)
                low = min(costs)
                found = tuple(c - low for c in costs)
                if found not in number:
                    number[found] = len(self.vectors)
                    self.vectors.append(found)
                row.append((number[found], low))
            one.append(row)
        step = np.array(one, np.int64)
        self.next, self.cost = [np.arange(len(one))[:, None]], [np.zeros((len(one), 1), np.int64)]
        for _ in range(block):
            rest, paid = self.next[-1], self.cost[-1]
            # The codes put the new symbol before those of the shorter block.
            self.next.append(np.concatenate([step[rest, s, 0] for s in range(SYMBOLS)], axis=1))
            self.cost.append(np.concatenate([paid + step[rest, s, 1] for s in range(SYMBOLS)], axis=1))
        self.expanded: dict = {}

    def blocks(self, symbols: bytes) -> list[tuple[int, int]]:
        """Length and code of each block; only the first may be short."""
        found, start = [], len(symbols) % self.block
        if start:
            found.append((start, self.code(symbols[:start])))
        return found + [(self.block, self.code(symbols[i : i + self.block])) for i in range(start, len(symbols), self.block)]

    @staticmethod
    def code(symbols: bytes) -> int:
        value = 0
        for s in symbols:
            value = value * SYMBOLS + s
        return value

    def over(self, symbols: bytes, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors before ``symbols`` and their costs, for vectors after them."""
        paid = np.zeros(len(vectors), np.int64)
        for length, code in reversed(self.blocks(symbols)):
            paid += self.cost[length][vectors, code]
            vectors = self.next[length][vectors, code]
        return vectors, paid

    def expand(self, length: int, code: int, vector: int, state: int) -> tuple[str, int]:
        """The least of the cheapest edits of one block, and the state after it."""
        key = (length, code, vector, state)
        if key in self.expanded:
            return self.expanded[key]
        symbols = [code // SYMBOLS**i % SYMBOLS for i in reversed(range(length))]
        costs = [list(self.vectors[vector])]
        for symbol in reversed(symbols):
            costs.append(before(costs[-1], symbol))
        costs.reverse()
        edits, at = "", 0
        while at < length:
            symbol, left, after = symbols[at], costs[at][state], costs[at + 1]
            role, cut = "sua?"[(symbol - 1) % 4] if symbol else "", KEEP_CUT * (symbol > 4)
            if left == DELETE + after[state]:
                edits += "D"
            elif left == INSERT + costs[at][WANTED[state][1]]:
                edits, state = edits + "I", WANTED[state][1]
                continue
            elif role in KEPT[state] and left == cut + after[KEPT[state][role]]:
                edits, state = edits + "K", KEPT[state][role]
            else:
                edits, state = edits + "R", WANTED[state][1]
            at += 1
        if len(self.expanded) >= 1_000_000:
            self.expanded.clear()
        self.expanded[key] = edits, state
        return edits, state

    def trace(self, symbols: bytes, vector: int, states: Sequence[int]) -> list[tuple[str, int]]:
        """Edits and last state for each first state, with ``vector`` after ``symbols``."""
        blocks, after = self.blocks(symbols), []
        for length, code in reversed(blocks):
            after.append(vector)
            vector = int(self.next[length][vector, code])
        found = []
        for state in states:
            edits = []
            for (length, code), right in zip(blocks, reversed(after)):
                part, state = self.expand(length, code, right, state)
                edits.append(part)
            found.append(("".join(edits), state))
        return found


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def closing(state: int) -> str:
    """The inserts that end a conversation."""
    return "I" * (END[state] // INSERT)


def applied(edits: str, state: int, turns: Sequence[tuple[str, str]]) -> list[dict]:
    """The turns that ``edits`` leave of ``turns`` (role and text), from a state on."""
    out, rest = [], iter(turns)
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K":
            state = KEPT[state][role[0]]
        else:
            role, state = WANTED[state]
        out.append({"role": role, "text": text})
    return out


def judged(rows: Sequence[tuple], repeated: Sequence[bool]) -> tuple[bytes, dict]:
    """The symbols of the rows, and what they have by themselves; ``rows`` are turn, role, text, symbol, ..."""
    symbols = bytes(0 if again else row[3] for row, again in zip(rows, repeated))
    blank = sum(row[3] == 0 for row in rows)
    initials = [row[1][:1] for row in rows]
    turns = [row[0] for row in rows if row[0] is not None]
    return symbols, {
        "blank": blank, "duplicate": symbols.count(0) - blank, "truncated": sum(s > 4 for s in symbols),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "head": initials[0] if rows else None, "tail": initials[-1] if rows else None,
        "least": turns[0] if turns else None, "most": turns[-1] if turns else None, "turns": len(set(turns)),
    }


def gaps(least: int | None, most: int | None, turns: int) -> int:
    return 0 if least is None else most - least + 1 - turns


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (``conv_id, turn, role, text``) with faults, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays with ``present`` false, so that its conversation is known), 1 empties the text, 2 takes
    its ``.!?``, 3 repeats the row, 4 makes it the user's. A null role or text is one space, as a null id or turn is in
    what is hashed. Other columns are left out.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).when(kind == 0, "").otherwise(blank("text"))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(kind != 0, F.when(kind == 3, 2).otherwise(1))).alias("present"),
    )
    return rows


def symbol_of(role: Column, text: Column) -> Column:
    """0 for a text without a visible character, else 1 to 4 by the role's initial, 4 more if the text ends early."""
    last = F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    place = F.when(role.startswith("s"), 1).when(role.startswith("u"), 2).when(role.startswith("a"), 3).otherwise(4)
    return F.when(last == "", 0).otherwise(place + F.when(last.isin(".", "!", "?"), 0).otherwise(4))


TURNS = "array<struct<role:string,text:string>>"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RAW = "array<struct<turn:bigint,role:string,text:string,symbol:int,h1:bigint,h2:bigint>>"


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def pieces(rows: DataFrame, piece_chars: int) -> DataFrame:
    """Sorted rows as whole repaired conversations and as raw pieces of the others, named by ``part`` and ``seq``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, seq int, whole boolean, " + "".join(f"{c} bigint, " for c in COUNTS)
    schema += f"audit string, repaired {TURNS}, raw {RAW}"
    arrow = arrow_schema(schema)
    fields = ["turn", "role", "text", "symbol", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, known = TaskContext.get().partitionId(), 0, tables()
        out: list[dict] = []
        weight = 0
        held, size, conv, cut = [], 0, None, True  # the first conversation of a task may have begun in another

        def raw() -> None:
            nonlocal seq
            out.append({"conv_id": conv, "part": part, "seq": seq, "whole": False, "raw": [dict(zip(fields, r)) for r in held]})
            seq += 1

        def finish() -> None:
            if cut:
                return raw()
            seen: set = set()
            repeated = [r[3] != 0 and (r[4:] in seen or seen.add(r[4:]) is not None) for r in held]
            symbols, found = judged(held, repeated)
            vectors, paid = known.over(symbols, np.zeros(1, np.int64))
            (edits, state), = known.trace(symbols, 0, [0])
            edits += closing(state)
            out.append({
                "conv_id": conv, "whole": True, "gaps": gaps(found["least"], found["most"], found["turns"]),
                **{c: found[c] for c in COUNTS[1:5]}, "cost": int(paid[0]) + known.vectors[vectors[0]][0],
                "audit": edits, "repaired": applied(edits, 0, [r[1:3] for r in held]),
            })

        any_row = False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not any_row:
                    conv, any_row = row[0], True
                elif row[0] != conv:
                    finish()
                    held, size, conv, cut = [], 0, row[0], False
                if row[7]:
                    held.append(row[1:7])
                    size += len(row[3]) + 100
                    weight += len(row[3]) + 100
                    if size >= piece_chars:
                        raw()
                        held, size, cut = [], 0, True
                if weight >= 4_000_000 or len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, weight = [], 0
        if any_row:
            raw()
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, schema)


def chained(raw: DataFrame) -> DataFrame:
    """The pieces of conversations that lie in several: their counts, edits and turns, piece by piece."""
    kind = raw.schema["conv_id"].dataType.simpleString()
    turns = raw.select("conv_id", "part", "seq", F.posexplode("raw").alias("pos", "r")).where("r.symbol != 0")
    first = turns.groupBy("conv_id", "r.h1", "r.h2").agg(F.min(F.struct("part", "seq", "pos")).alias("f"))
    firsts = first.groupBy("f.part", "f.seq").agg(F.collect_list("f.pos").alias("firsts"))
    known = f"conv_id {kind}, part int, seq int"
    own = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, least bigint, most bigint, turns bigint"

    def each(function, schema: str):
        """A function from row to rows as one over batches."""
        target = arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):  # a piece may be some MB
                    if found := function(batch.slice(i, 1).to_pylist()[0]):
                        yield pa.RecordBatch.from_pylist(found, target)

        return run

    def summary(row: dict) -> list[dict]:
        rows = [(t["turn"], t["role"], t["text"], t["symbol"]) for t in row["raw"]]
        new = set(row["firsts"] or ())
        symbols, found = judged(rows, [r[3] != 0 and i not in new for i, r in enumerate(rows)])
        to, paid = tables().over(symbols, np.arange(len(tables().vectors)))
        kept = [{"role": r[1], "text": r[2]} for r in rows]
        return [{k: row[k] for k in ("conv_id", "part", "seq")} | found | {"symbols": symbols, "to": to.tolist(), "paid": paid.tolist(), "raw": kept}]

    schema = f"{known}, {own}, symbols binary, to array<bigint>, paid array<bigint>, raw {TURNS}"
    judged_pieces = raw.select("conv_id", "part", "seq", "raw").join(firsts, ["part", "seq"], "left").mapInArrow(each(summary, schema), schema)
    judged_pieces = written(judged_pieces, "pieces")

    def grouped(df: DataFrame, *columns: str) -> DataFrame:
        return df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", *columns))).alias("pieces"))

    def vectors(row: dict) -> list[dict]:
        """From the last piece to the first: the vector after each. And what the pieces have together."""
        vector, cost, parts, total = 0, 0, row["pieces"], dict.fromkeys(COUNTS, 0)
        place = []
        for p in reversed(parts):
            place.append(vector)
            cost += p["paid"][vector]
            vector = p["to"][vector]
        total["cost"] = cost + tables().vectors[vector][0]
        least = most = tail = None
        count = 0
        for p in parts:
            for c in COUNTS[1:5]:
                total[c] += p[c]
            if tail is not None and p["head"] is not None:
                total["illegal"] += tail + p["head"] not in ("su", "ua", "au")
            tail = tail if p["tail"] is None else p["tail"]
            if p["least"] is not None:
                count += p["turns"] - (p["least"] == most)
                least, most = p["least"] if least is None else least, p["most"]
        total["gaps"] = gaps(least, most, count)
        return [
            {"part": p["part"], "seq": p["seq"], "vector": v, "piece": i, "pieces": len(parts)} | total
            for i, (p, v) in enumerate(zip(parts, reversed(place)))
        ]

    placed = "part int, seq int, vector int, piece int, pieces int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    names = [f.split()[0] for f in own.split(", ")]
    after = written(grouped(judged_pieces, *names, "to", "paid").mapInArrow(each(vectors, placed), placed), "vectors")

    def traced(row: dict) -> list[dict]:
        found = tables().trace(row["symbols"], row["vector"], range(4))
        return [{k: row[k] for k in ("conv_id", "part", "seq")} | {"edits": [e for e, _ in found], "ends": [s for _, s in found]}]

    traces = f"{known}, edits array<string>, ends array<int>"
    edits = judged_pieces.select("conv_id", "part", "seq", "symbols").join(after.select("part", "seq", "vector"), ["part", "seq"])
    edits = written(edits.mapInArrow(each(traced, traces), traces), "edits")

    def entered(row: dict) -> list[dict]:
        state, found = 0, []
        for p in row["pieces"]:
            found.append({"part": p["part"], "seq": p["seq"], "state": state, "closing": ""})
            state = p["ends"][state]
        found[-1]["closing"] = closing(state)
        return found

    entries = "part int, seq int, state int, closing string"
    begun = grouped(edits, "ends").mapInArrow(each(entered, entries), entries)
    chosen = edits.join(begun, ["part", "seq"]).select("part", "seq", "state", F.concat(F.get("edits", F.col("state")), "closing").alias("audit"))

    def rebuilt(row: dict) -> list[dict]:
        found = applied(row["audit"], row["state"], [(t["role"], t["text"]) for t in row["raw"]])
        return [{k: row[k] for k in ("conv_id", "piece", "pieces", *COUNTS, "audit")} | {"repaired": found}]

    result = f"conv_id {kind}, piece int, pieces int, " + "".join(f"{c} bigint, " for c in COUNTS) + f"audit string, repaired {TURNS}"
    whole = judged_pieces.select("conv_id", "part", "seq", "raw").join(after, ["part", "seq"]).join(chosen, ["part", "seq"])
    return whole.mapInArrow(each(rebuilt, result), result)


def repaired(rows: DataFrame, present: str | None = None, piece_chars: int = 4_000_000) -> DataFrame:
    """The cheapest repair of each conversation of ``rows`` (``conv_id, turn, role, text``).

    One row per conversation, or per piece of one that crosses tasks or ``piece_chars``: ``conv_id, piece, pieces``, its
    counts (``gaps, blank, duplicate, truncated, illegal, cost``, those of the whole conversation), ``audit`` (K, R, D
    and I per edit, of this piece) and ``repaired``, the turns of the piece. Turns are taken by ``turn``, nulls first,
    equal ones by role and text. A null role or text is one space. Rows whose ``present`` is false only name their
    conversation; one without rows has zeros and no edits. Null ids are one conversation. Equal turns are told by
    128-bit hashes of role and text. Other columns are not read; an empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    chosen = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), symbol_of(role, text).alias("symbol"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"),
        F.monotonically_increasing_id().alias("tie"),  # spreads a row that is repeated very often
    )
    keys = ["conv_id", "turn", "role", "text", "tie"]
    placed = chosen.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    found = written(pieces(placed, piece_chars), "conversations")
    whole = found.where("whole").select("conv_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), *COUNTS, "audit", "repaired")
    return whole.unionByName(chained(found.where("NOT whole")))


def digests(found: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired``: the counts, the whole ``audit``, and ``repaired_sha256``, the SHA-256 of
    its ``role:text`` lines. A conversation in pieces is hashed piece after piece, as SHA-256 asks, one at a time."""
    kind = found.schema["conv_id"].dataType.simpleString()
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    one = found.where("pieces = 1").select("conv_id", *COUNTS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    several = found.where("pieces > 1")
    schema = f"conv_id {kind}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, total, begun, ids, hashes = None, None, False, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if total is None or row["conv_id"] != conv:
                    if total is not None:
                        ids.append(conv)
                        hashes.append(total.hexdigest())
                    conv, total, begun = row["conv_id"], hashlib.sha256(), False
                for line in row["lines"]:
                    total.update(("\n" * begun + line).encode())
                    begun = True
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids, conv], batch.schema.field("conv_id").type), pa.array([*hashes, total.hexdigest()], pa.string())],
                ["conv_id", "repaired_sha256"],
            )

    ordered = several.select("conv_id", "piece", lines.alias("lines")).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    hashed = ordered.mapInArrow(run, schema).select(F.col("conv_id").alias("_conv"), "repaired_sha256")
    edits = several.groupBy("conv_id", *COUNTS).agg(F.sort_array(F.collect_list(F.struct("piece", "audit"))).alias("a"))
    edits = edits.select("conv_id", *COUNTS, F.array_join(F.col("a.audit"), "").alias("audit"))
    return one.unionByName(edits.join(hashed, edits["conv_id"].eqNullSafe(F.col("_conv"))).drop("_conv"))
