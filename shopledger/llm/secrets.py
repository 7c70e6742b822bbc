"""Secret scans by one deterministic automaton for all rules.

The rules are compiled together: an automaton over byte classes by subset construction, made smallest by refining
state classes, as one array of transitions. One pass over the bytes reports for every rule where its trigger ends, the
shortest prefix after which it is sure to match, and every byte on which the whole rule has matched; a match reaches
from its trigger to the last of the bytes in a row. Only the starts of matches are read off the text.

A batch of texts is cut into pieces that are scanned side by side, a byte of each per step. A piece starts in the
start state; where the piece before ends in another state, it is scanned again from there until the states agree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from re import _constants as op, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks

#: Between texts; this byte never occurs in UTF-8.
BREAK = 0xFF

WORDLIKE = "A-Za-z0-9+/_.=-"
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
TAILS = {
    "assign": WORDLIKE, "access": "A-Z0-9", "hex": "0-9a-f", "github": "A-Za-z0-9", "jwt": "A-Za-z0-9_.-", "pem": "",
}
#: Shortest values: the second group of ``assign``, whole matches of the others.
SHORTEST = {"assign": 6, "access": 20, "hex": 24, "github": 40, "jwt": 30}


def any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN_HEAD = "(?:" + "|".join(map(any_case, KEYWORDS)) + r")[\"']?\x20*[:=]\x20*[\"']?"
#: The trigger of each kind, in the order in which kinds are listed; the last three are the method's own.
TRIGGERS = {
    "assign": ASSIGN_HEAD + f"[{WORDLIKE}]",
    "access": "AKIA[A-Z0-9]",
    "hex": "[0-9a-f]{24}",
    "github": "gh[pousr]_[A-Za-z0-9]",
    "jwt": "eyJ[A-Za-z0-9_-]",
    "pem": "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}
KINDS = tuple(TRIGGERS)
BASE = KINDS[:3]
#: Whole rules of the kinds that go on after their trigger, and the two parts of the end of ``pem``.
WHOLE = {k: f"{TRIGGERS[k]}[{tail}]*" for k, tail in TAILS.items() if tail}
CLOSING = ("-----END", "-----")
TRIGGER_LENGTH = {"access": 5, "hex": 24, "github": 5, "jwt": 4}


class Automaton:
    """Transitions of the smallest automaton that reports every end of every pattern in one pass.

    ``classes`` maps bytes to columns; ``step[state + column]`` is the next state, states being multiples of
    ``width``; states from ``accepting`` on report ``rules[state // width]``, a bit per pattern.
    """

    def __init__(self, patterns: Sequence[str]):
        edges: list[list[tuple[frozenset[int], int]]] = []
        empty: list[list[int]] = []

        def state() -> int:
            edges.append([])
            empty.append([])
            return len(edges) - 1

        def build(items, at: int) -> int:
            for kind, value in items:
                if kind is op.LITERAL or kind is op.IN:
                    at = add(at, byte_set(kind, value))
                elif kind is op.SUBPATTERN:
                    at = build(value[3], at)
                elif kind is op.BRANCH:
                    end = state()
                    for branch in value[1]:
                        empty[build(branch, at)].append(end)
                    at = end
                elif kind is op.MAX_REPEAT:
                    least, most, body = value
                    for _ in range(least):
                        at = build(body, at)
                    if most is op.MAXREPEAT:
                        loop = state()
                        empty[at].append(loop)
                        empty[build(body, loop)].append(loop)
                        at = loop
                    else:
                        end = state()
                        for _ in range(most - least):
                            empty[at].append(end)
                            at = build(body, at)
                        empty[at].append(end)
                        at = end
                else:
                    raise ValueError(f"not supported in a trigger: {kind}")
            return at

        def add(at: int, values: frozenset[int]) -> int:
            to = state()
            edges[at].append((values, to))
            return to

        def byte_set(kind, value) -> frozenset[int]:
            if kind is op.LITERAL:
                return frozenset([value])
            found: set[int] = set()
            for inner, v in value:
                found |= set(range(v[0], v[1] + 1)) if inner is op.RANGE else {v}
            return frozenset(found)

        start = state()
        ends = {}
        for i, pattern in enumerate(patterns):
            first = state()
            empty[start].append(first)
            ends[build(_parser.parse(pattern), first)] = 1 << i

        def closure(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for to in empty[todo.pop()]:
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
            return frozenset(seen)

        # Bytes that no pattern tells apart share a column.
        marks = [0] * 256
        for number, values in enumerate({values for out in edges for values, _ in out}):
            for value in values:
                marks[value] |= 1 << number
        kinds = {mark: i for i, mark in enumerate(dict.fromkeys(marks))}
        self.classes = np.array([kinds[mark] for mark in marks], dtype=np.uint16)
        self.width = len(kinds)
        sample = {kinds[marks[b]]: b for b in range(256)}

        # Subset construction; the start set is part of every set, as a match may begin anywhere.
        begin = closure([start])
        number, order, rows = {begin: 0}, [begin], []
        for current in order:
            row = []
            for column in range(self.width):
                byte = sample[column]
                to = closure({t for s in current for values, t in edges[s] if byte in values} | begin)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        bits = [sum({ends[s] for s in current if s in ends}) for current in order]

        # States are equal if they report the same and lead to equal states.
        group = bits
        while True:
            keys = [(group[s], tuple(group[t] for t in rows[s])) for s in range(len(rows))]
            names = {key: i for i, key in enumerate(dict.fromkeys(keys))}
            refined = [names[key] for key in keys]
            if len(names) == len(set(group)):
                break
            group = refined
        first_of = {}
        for s, g in enumerate(refined):
            first_of.setdefault(g, s)
        # The start state is 0, reporting states come last.
        ranked = sorted(first_of, key=lambda g: (bits[first_of[g]] != 0, first_of[g]))
        place = {g: i for i, g in enumerate(ranked)}
        self.rules = np.array([bits[first_of[g]] for g in ranked], dtype=np.int64)
        self.accepting = int((self.rules == 0).sum()) * self.width
        table = [[place[refined[t]] * self.width for t in rows[first_of[g]]] for g in ranked]
        self.step = np.array(table, dtype=np.int32).ravel()
        self.steps = self.step.tolist()

    def ends(self, data: np.ndarray, piece: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last bytes of all triggers in ``data`` (bytes), ascending, and the bits of their rules."""
        lanes = -(-len(data) // piece)
        if not lanes:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        columns = np.full(lanes * piece, self.classes[BREAK], np.int32)
        columns[: len(data)] = self.classes[data]
        columns = np.ascontiguousarray(columns.reshape(lanes, piece).T)
        states = np.empty((piece, lanes), np.int32)
        now = np.zeros(lanes, np.int32)
        for i in range(piece):
            now = np.add(now, columns[i], out=states[i])
            now = self.step.take(now, out=states[i])
        step, start = self.steps, 0
        for lane in range(lanes):
            if start:  # the piece was scanned from the start state: mend it until the states agree
                at = start
                for top in range(0, piece, 256):
                    mended = []
                    for column, old in zip(columns[top : top + 256, lane].tolist(), states[top : top + 256, lane].tolist()):
                        at = step[at + column]
                        if at == old:
                            break
                        mended.append(at)
                    states[top : top + len(mended), lane] = mended
                    if len(mended) < min(256, piece - top):
                        break
            start = int(states[-1, lane])
        places = states.T.ravel()
        hits = np.flatnonzero(places >= self.accepting)
        hits = hits[hits < len(data)]
        return hits, self.rules[places[hits] // self.width]


@lru_cache(maxsize=4)
def automaton(kinds: tuple[str, ...] = KINDS) -> Automaton:
    """Bits: the triggers of ``kinds``, then the whole rules of those that have one, then the end of ``pem``."""
    return Automaton([TRIGGERS[k] for k in kinds] + [WHOLE[k] for k in kinds if k in WHOLE] + list(CLOSING))


KEYWORD_END = re.compile(("(?:" + "|".join(map(any_case, KEYWORDS)) + r")\Z").encode())


def assign_start(data: bytes, value: int, low: int) -> int:
    """Where the keyword begins whose value begins at ``value``; the head is read backwards."""
    i = value
    if data[i - 1] in b"\"'":
        i -= 1
    while data[i - 1] == 0x20:
        i -= 1
    i -= 1  # the sign
    while data[i - 1] == 0x20:
        i -= 1
    if data[i - 1] in b"\"'":
        i -= 1
    near = max(low, i - 8)
    return near + KEYWORD_END.search(data[near:i]).start()


def following(places: np.ndarray, least: np.ndarray, none: int) -> np.ndarray:
    """Per value of ``least`` the first of the ascending ``places`` not below it, ``none`` where there is none."""
    return np.r_[places, none][np.searchsorted(places, least)]


def ends_of(kind: str, at: np.ndarray, whole: np.ndarray, closing: tuple[np.ndarray, np.ndarray], high: np.ndarray) -> np.ndarray:
    """Ends of the matches whose triggers end at ``at``, in texts that end at ``high``.

    ``whole`` are the bytes on which the whole rule has matched, ``closing`` the last bytes of the two parts of ``pem``.
    """
    if kind == "pem":
        beyond = int(high.max(initial=0))
        close = following(closing[0], at + len(CLOSING[0]), beyond)
        tail = following(closing[1], close + len(CLOSING[1]), beyond)
        return np.where(tail < high, tail, at) + 1
    last = whole[np.flatnonzero(np.r_[np.diff(whole) != 1, True])] if len(whole) else whole
    return following(last, at, -1) + 1


def spans_of(data: bytes, low: int, hits: Sequence[tuple[int, int, int]], kinds: Sequence[str]) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` in bytes of the text from ``low`` on, from ``(end of trigger, kind number, end)``."""
    found = []
    done = [low] * len(kinds)  # per kind, the end of the last match
    for at, k, end in hits:
        kind = kinds[k]
        if at < done[k]:
            continue
        if kind == "assign":
            start = assign_start(data, at, low)
            if start < done[k]:
                continue
            keep = end - at >= SHORTEST[kind]
        elif kind == "pem":
            start, keep = data.rindex(b"-----BEGIN", low, at), True
        else:
            start = at + 1 - TRIGGER_LENGTH[kind]
            keep = end - start >= SHORTEST[kind] and (kind != "jwt" or data.count(b".", start, end) == 2)
        done[k] = end
        if keep:
            found.append((start, k, end))
    return sorted(found)


def scan_texts(texts: Sequence[str | None], kinds: tuple[str, ...] = KINDS) -> list[list[tuple[int, int, int]]]:
    """Per text, its spans ``(start, kind number, end)`` in code points, end exclusive, by start, then kind."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = bytes([BREAK]).join(encoded)
    bounds = np.cumsum([0, *[len(e) + 1 for e in encoded]])
    places, bits = automaton(kinds).ends(np.frombuffer(data, np.uint8))
    result: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owner = np.searchsorted(bounds, places, side="right") - 1
    marked = lambda bit: places[(bits >> bit & 1).astype(bool)]
    runs = [k for k in kinds if k in WHOLE]
    closing = (marked(len(kinds) + len(runs)), marked(len(kinds) + len(runs) + 1))
    found = []
    for k, kind in enumerate(kinds):
        here = np.flatnonzero(bits >> k & 1)
        whole = marked(len(kinds) + runs.index(kind)) if kind in WHOLE else places[:0]
        ends = ends_of(kind, places[here], whole, closing, bounds[owner[here] + 1] - 1)
        found.append(np.stack([owner[here], places[here], np.full(len(here), k), ends]))
    hits = np.concatenate(found, axis=1)
    hits = hits[:, np.lexsort((hits[2], hits[1]))]
    cuts = [0, *(np.flatnonzero(np.diff(hits[0])) + 1), hits.shape[1]] if hits.shape[1] else [0]
    for a, b in zip(cuts, cuts[1:]):
        n = int(hits[0, a])
        low = int(bounds[n])
        spans = spans_of(data, low, list(zip(*hits[1:, a:b].tolist())), kinds)
        if len(texts[n]) == len(encoded[n]):
            result[n] = [(s - low, k, e - low) for s, k, e in spans]
        elif spans:
            # Code points before each byte; only bytes 10xxxxxx do not begin one.
            before = np.cumsum((np.frombuffer(encoded[n], np.uint8) & 0xC0) != 0x80)
            result[n] = [(int(before[s - low]) - 1, k, int(before[e - low - 1])) for s, k, e in spans]
    return result


def written_spans(spans: Sequence[tuple[int, int, int]], kinds: Sequence[str] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    ``spans`` lists ``kind:start:end`` in code points, end exclusive, by start, then kind; ``base_sha256`` is the
    hash of the same list of the three base kinds. Base matches of a kind do not overlap; spans of different kinds
    may. Null and empty texts have no spans. Rows are judged one by one, so equal ids and null ids are kept as they
    are; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in chunks(batch, "text"):
                found = scan_texts(texts)
                counts = [[sum(k == kind for _, k, _ in spans) for spans in found] for kind in range(len(BASE))]
                digests = [
                    hashlib.sha256(written_spans([s for s in spans if s[1] < len(BASE)]).encode()).hexdigest()
                    for spans in found
                ]
                ids = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(map(written_spans, found))],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(text: str, spans: Sequence[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones together, replaced by ``mark``."""
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the secrets of ``column`` replaced by ``[SECRET]``; other columns and null texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(column)
            for start, texts in chunks(batch, column):
                found = scan_texts(texts)
                clean = [t if not spans else redacted(t, spans) for t, spans in zip(texts, found)]
                part = batch.slice(start, len(texts))
                yield part.set_column(place, batch.schema.field(place), pa.array(clean, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
