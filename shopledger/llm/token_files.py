"""Token ids in binary files: an adaptive context-mixing range coder over independent, checksummed blocks.

Documents are put in ``doc_id`` order, tokenized, and their ids cut into blocks. A block is coded by itself: orders
2 and 1 predict the id that last followed their context, order 0 has adaptive shares for 256 groups of ids. Orders 2
and 1 are given weights by how often they were right of late, weights of orders that agree add up, and the mixture
drives an arithmetic coder. All blocks of a segment are coded side by side, one id of each per step, in numpy.

A segment is one binary value:

    "TIDS", version u16, ids per block u32, documents u32, ids u64        (little-endian, as all numbers)
    per document: doc_id i64 (null: -2^63), ids u64;  CRC-32 of the above u32
    per block: ids u32, bytes u32, CRC-32 of the bytes u32, bytes

Segments are rows of a Parquet table, which Spark can write to any store; ``part`` and ``segment`` give their order.
"""

from __future__ import annotations

import json
import math
import os
import string
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import new_path, small

BLOCK = 1024
LANES = 4096
SLOTS = 1024
UNITS = 1024
NO_ID = -(1 << 63)
#: No prediction. The highest id is so never predicted by orders 1 and 2, only by order 0.
NONE = (1 << 16) - 1
#: Code space of order 0: for each of 256 places in a group, the units of all groups.
ORDER_0 = UNITS * 256
LEVELS = 16
#: The coder works on two digits of 24 bits.
DIGIT = float(1 << 24)
WHOLE = DIGIT * DIGIT
HEAD = struct.Struct("<4sHIIQ")
#: White space by its number of bytes.
SPACES = {n: [int.from_bytes(c, "big") for i in range(0x3100) if chr(i).isspace() and len(c := chr(i).encode()) == n] for n in (1, 2, 3)}


def mixture() -> tuple[np.ndarray, ...]:
    """The space that orders 0, 1 and 2 have by the trust in the last two, and what trust follows.

    By state (8 * (17 * trust in order 1 + trust in order 2) + 1 if order 1 predicts + 2 if order 2 does + 4 if the
    same): the share of a unit in all space, and where the space of order 2 begins. By 4 * state + what came true (0:
    neither, 1: order 1, 2: order 2): begin and size of its space (order 0: zeros), and the trust after it, as the
    state without predictions. The whole space is a power of two, so its units are whole numbers.
    """
    count = 8 * (LEVELS + 1) ** 2
    share, two_from = np.ones(count), np.zeros(count)
    begin, size, after = np.zeros((count, 4)), np.zeros((count, 4)), np.zeros((count, 4), np.int64)
    for state in range(count):
        trust, seen = divmod(state, 8)
        both = divmod(trust, LEVELS + 1)
        one, two = both[0] * (seen & 1), both[1] * (seen >> 1 & 1)
        p, q = one / (LEVELS + 1), two / (LEVELS + 1)
        doubled = min(5, max(int(one + two > 0), round(-math.log2((1 - p) * (1 - q)))))
        mass, mass_2 = ((1 << doubled) - 1) * ORDER_0, 0
        if two:
            mass_2 = mass if not one or seen & 4 else min(mass - 1, max(1, int(mass * q / (q + p * (1 - q)))))
        share[state] = 1 / (ORDER_0 << doubled)
        two_from[state] = ORDER_0 + mass - mass_2
        begin[state] = 0, ORDER_0, two_from[state], 0
        size[state] = 0, mass - mass_2, mass_2, 0
        for true in range(3):
            right = true == 1 or true == 2 and seen & 4, true == 2 or true == 1 and seen & 4
            new = [
                t if not has else min(LEVELS, t + 1) if hit else max(1, t - max(1, t // 4))
                for t, has, hit in zip(both, (seen & 1, seen & 2), right)
            ]
            after[state, true] = 8 * (new[0] * (LEVELS + 1) + new[1])
    return share, two_from, begin.ravel(), size.ravel(), after.ravel()


SHARE, TWO_FROM, BEGIN, SIZE, AFTER = mixture()
#: The trust in both orders at the start, as a state.
TRUST = 8 * (LEVELS // 2 * (LEVELS + 1) + LEVELS // 2)


class Order0:
    """Shares of 256 groups of ids in many blocks at once, made anew at some steps from the ids before."""

    def __init__(self, lanes: int, steps: int):
        self.lanes = lanes
        self.group = np.arange(lanes, dtype=np.int64) * 256
        # Counts times units are below 2^31 in blocks of common sizes.
        self.counts = np.zeros(lanes * 256, np.int32 if steps < 1 << 21 else np.int64)
        self.counted = 0
        self.share()

    def share(self) -> None:
        """Units of each group, at least one, from the counts so far; what rounding leaves goes to group 0.

        A number per group holds the unit at which it begins and, in its low 11 bits, how many it has.
        """
        units = self.counts.reshape(self.lanes, 256) * (UNITS - 256) // max(1, self.counted)
        units += 1
        ends = np.cumsum(units, axis=1, dtype=np.int32)
        rest = UNITS - ends[:, -1:]
        units[:, :1] += rest
        ends += rest
        ends <<= 11
        ends -= units * ((1 << 11) - 1)
        self.shares = ends.ravel()

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of groups, and the first of them."""
        found = self.shares.take(at)
        return found & ((1 << 11) - 1), found >> 11

    def owners(self) -> np.ndarray:
        """The group of every unit, for decoding."""
        return np.repeat(np.tile(np.arange(256, dtype=np.uint8), self.lanes), self.shares & ((1 << 11) - 1))

    @staticmethod
    def due(steps: int) -> bool:
        return steps in (16, 64, 128) or not steps % 256

    def learn(self, groups: np.ndarray, steps: int) -> None:
        """Count groups of ids, with ``group`` added, up to a step."""
        self.counts += np.bincount(groups.ravel(), minlength=self.lanes * 256)
        self.counted = steps
        self.share()


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The bytes of each row of ``ids`` (blocks by steps, ids below 65,536).

    All ids are known, so what the orders predict, the trust, and the places in the space are found one after the
    other for some steps at once. The numbers of the coder are whole and below 2^53, so exact as doubles.
    """
    lanes, steps = ids.shape
    ids = ids.astype(np.uint16)
    model, slot, trust = Order0(lanes, steps), np.arange(lanes, dtype=np.int64) * SLOTS, np.full(lanes, TRUST, np.int64)
    table_1, table_2 = np.full(lanes * SLOTS, NONE, np.uint16), np.full(lanes * SLOTS, NONE, np.uint16)
    low, span = np.zeros(lanes), np.full(lanes, WHOLE)
    out, due = np.empty((steps + 2, lanes), np.int32), np.ones((steps + 2, lanes), bool)
    ends = [end for end in range(1, steps) if model.due(end) or not end % 32] + [steps]
    rows = np.zeros((2, lanes), np.uint16)
    for start, end in zip([0, *ends], ends):
        # The ids of the steps, after those of two steps before.
        rows = np.concatenate([rows[-2:], ids[:, start:end].T])
        last, new = rows[1:-1], rows[2:]
        at_1, at_2 = (last & (SLOTS - 1)) + slot, ((last ^ rows[:-2] << 3) & (SLOTS - 1)) + slot
        id_1, id_2 = np.empty_like(new), np.empty_like(new)
        for here_1, here_2, found_1, found_2, x in zip(at_1, at_2, id_1, id_2, new):
            found_1[:], found_2[:] = table_1.take(here_1), table_2.take(here_2)
            table_1[here_1] = x
            table_2[here_2] = x
        has_1, has_2 = id_1 != NONE, id_2 != NONE
        hit_2 = ((id_2 == new) & has_2).view(np.uint8)
        true = np.maximum(((id_1 == new) & has_1).view(np.uint8), hit_2 << 1)
        seen = has_1.view(np.uint8) + (has_2.view(np.uint8) << 1) + ((id_1 == id_2).view(np.uint8) << 2)
        events = ((seen << 2) + true).astype(np.int64)
        for event in events:
            event += trust << 2
            trust = AFTER.take(event)
        begins, sizes, shares = BEGIN.take(events), SIZE.take(events), SHARE.take(events >> 2)
        units, first = model.of((new >> 8) + model.group)
        first += (new & 255).astype(np.int32) * UNITS
        neither = (true == 0).view(np.uint8)
        units *= neither
        first *= neither
        sizes += units
        begins += first
        for share, begin, size, digit, short in zip(shares, begins, sizes, out[start:], due[start:]):
            unit = np.floor(span * share)
            low += unit * begin
            span = unit * size
            # A carry makes a digit of more than 24 bits; it is passed on at the end. Digits not due are dropped.
            np.less_equal(span, DIGIT, out=short)
            high = np.floor(low * (1 / DIGIT))
            digit[:] = high
            low = np.where(short, (low - high * DIGIT) * DIGIT, low)
            span = np.where(short, span * DIGIT, span)
        if end < steps and model.due(end):
            model.learn((ids[:, model.counted : end] >> 8) + model.group[:, None], end)
    high = np.floor(low * (1 / DIGIT))
    out[steps], out[steps + 1] = high, low - high * DIGIT
    digits, ends = out.T[due.T], np.cumsum(due.sum(axis=0)) * 3
    while len(over := np.flatnonzero(digits >> 24)):
        digits[over] &= (1 << 24) - 1
        digits[over - 1] += 1
    data = digits.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def decode_blocks(coded: list[bytes], steps: int) -> np.ndarray:
    """The ids of blocks of ``steps`` ids each."""
    lanes = len(coded)
    places = np.frombuffer(b"".join(coded) + bytes(3), np.uint8).reshape(-1, 3).T.astype(np.float32)
    # 24 bits fit a float.
    digits = places[0] + places[1] * (1 << 8) + places[2] * (1 << 16)
    at = np.cumsum([0] + [len(c) // 3 for c in coded[:-1]])
    code, span = digits[at] * DIGIT + digits[at + 1].astype(np.float64), np.full(lanes, WHOLE)
    at += 2
    model, out = Order0(lanes, steps), np.empty((steps, lanes), np.uint16)
    slot, unit_at = np.arange(lanes, dtype=np.int64) * SLOTS, np.arange(lanes, dtype=np.int64) * UNITS
    table_1, table_2 = np.full(lanes * SLOTS, NONE, np.uint16), np.full(lanes * SLOTS, NONE, np.uint16)
    last_1, last_2 = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16)
    trust, owners = np.full(lanes, TRUST, np.int64), model.owners()
    for step in range(steps):
        at_1, at_2 = (last_1 & (SLOTS - 1)) + slot, ((last_1 ^ last_2 << 3) & (SLOTS - 1)) + slot
        id_1, id_2 = table_1.take(at_1), table_2.take(at_2)
        seen = (id_1 != NONE).view(np.uint8) + ((id_2 != NONE).view(np.uint8) << 1) + ((id_1 == id_2).view(np.uint8) << 2)
        state = trust + seen
        unit = np.floor(span * SHARE.take(state))
        # Exact: the quotient and its distance from the next whole number fit a double.
        value = np.floor(code / unit)
        in_2, in_any = value >= TWO_FROM.take(state), value >= ORDER_0
        event = (state << 2) + (in_any.view(np.uint8) + in_2.view(np.uint8))
        rest = value.astype(np.int32) & (ORDER_0 - 1)
        owned = rest & (UNITS - 1)
        group = owners.take(owned + unit_at)
        units, first = model.of(group + model.group)
        ids = np.where(in_any, np.where(in_2, id_2, id_1), (group.astype(np.uint16) << 8) + (rest >> 10).astype(np.uint16))
        rest -= owned
        rest += first
        code -= unit * np.where(in_any, BEGIN.take(event), rest)
        span = unit * np.where(in_any, SIZE.take(event), units)
        short = span <= DIGIT
        code = np.where(short, code * DIGIT + digits.take(at), code)
        span = np.where(short, span * DIGIT, span)
        at += short
        table_1[at_1] = ids
        table_2[at_2] = ids
        trust = AFTER.take(event)
        last_2, last_1 = last_1, ids
        out[step] = ids
        if step + 1 < steps and model.due(step + 1):
            new = np.ascontiguousarray((out[model.counted : step + 1] >> 8).astype(np.uint8).T)
            model.learn(new + model.group[:, None], step + 1)
            owners = model.owners()
    return out.T


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment. Ids must be below 65,536."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("ids of 65,536 and more are not supported")
    head = HEAD.pack(b"TIDS", 2, block, len(doc_ids), len(ids))
    head += np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes()
    parts = [head, struct.pack("<I", zlib.crc32(head))]
    full = np.zeros(-(-len(ids) // block) * block, np.int64)
    full[: len(ids)] = ids
    rows = full.reshape(-1, block)
    for start in range(0, len(rows), LANES):
        for i, coded in enumerate(encode_blocks(rows[start : start + LANES]), start):
            parts += [struct.pack("<III", min(block, len(ids) - i * block), len(coded), zlib.crc32(coded)), coded]
    return b"".join(parts)


def unpack(segment: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a segment; ``ValueError`` if a checksum is wrong."""
    magic, version, block, documents, total = HEAD.unpack_from(segment)
    if magic != b"TIDS" or version != 2:
        raise ValueError("not a segment of token ids")
    at = HEAD.size + 16 * documents
    if zlib.crc32(segment[:at]) != struct.unpack_from("<I", segment, at)[0]:
        raise ValueError("checksum of the head")
    doc_ids = np.frombuffer(segment, "<i8", documents, HEAD.size)
    lengths = np.frombuffer(segment, "<u8", documents, HEAD.size + 8 * documents).astype(np.int64)
    at += 4
    coded = []
    while at < len(segment):
        _, size, crc = struct.unpack_from("<III", segment, at)
        coded.append(segment[at + 12 : at + 12 + size])
        if zlib.crc32(coded[-1]) != crc:
            raise ValueError(f"checksum of block {len(coded) - 1}")
        at += 12 + size
    ids = [decode_blocks(coded[s : s + LANES], block).ravel() for s in range(0, len(coded), LANES)]
    flat = np.concatenate(ids)[:total] if ids else np.empty(0, np.int64)
    return [None if d == NO_ID else d for d in doc_ids.tolist()], lengths, flat


class Tokens:
    """Ids of pieces of text from the tokenizers library, as little-endian 32-bit numbers, kept up to a bound.

    Texts are cut where the vocabulary's own split cuts whatever stands on either side: before a blank and around a
    line feed between visible characters, and between a letter and punctuation. Equal pieces have equal ids wherever
    they are, so Arrow tells them apart and finds the known ones. Half of the bound are pieces used of late,
    ``before`` the half that was so until then; what comes again moves on. Long pieces are not kept.
    """

    def __init__(self, text: str, most: int = 2_000_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.library, self.most, self.longest = Tokenizer.from_str(text), most, longest
        # Pieces known, and the ids of each.
        self.known = self.before = pa.array([], pa.large_binary())
        self.known_ids = self.before_ids = pa.array([], pa.large_binary())
        # A character of a byte-level token is a byte; other tokens are spelled as they are.
        spelled = self.library.get_vocab(with_added_tokens=True).items()
        self.sizes = np.zeros(max((i for _, i in spelled), default=-1) + 1, np.int64)
        added = {t["content"] for t in json.loads(text)["added_tokens"]}
        for token, i in spelled:
            self.sizes[i] = len(token.encode()) if token in added else len(token)
        split = json.loads(text)["pre_tokenizer"]
        self.cuts = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.cuts = self.cuts and not set(" \n") & set("".join(added))
        # Added tokens are found before the split, so no cut may lie inside them.
        stops = set(string.punctuation) - set("".join(added))
        # Marks of bytes: white space, blank, line feed, punctuation at which texts may be cut, letter, and the first
        # bytes of characters of two and of three bytes that may be white space, and of letters of two bytes.
        groups = [SPACES[1], [32], [10], map(ord, stops), string.ascii_letters.encode(), [0xC2], [0xE1, 0xE2, 0xE3], [*range(0xC3, 0xCA), 0xD0, 0xD1]]
        marks = np.zeros(256, np.uint8)
        for bit, group in enumerate(groups):
            marks[list(group)] |= 1 << bit
        self.marks = marks.tobytes()

    def __len__(self) -> int:
        return len(self.known)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: pa.Array, between: str = "", together: int = 100) -> pa.Array:
        """The ids of pieces that end with a visible character, many encoded as one text.

        They begin with a blank and a visible character, or with a visible one if ``between`` is a line feed.
        """
        texts = pieces.cast(pa.large_string()).to_pylist()
        if not texts:
            return pieces
        joined = [between.join(texts[i : i + together]) for i in range(0, len(texts), together)]
        found = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(joined, add_special_tokens=False)]
        ids, lengths = np.concatenate(found), pc.binary_length(pieces).to_numpy()
        gaps = np.full(len(texts), len(between))
        gaps[together - 1 :: together] = gaps[-1] = 0
        ends = np.cumsum(lengths + gaps) - gaps
        # The tokens that begin and end each piece, by the bytes at which tokens begin, and the end.
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        first, last = np.searchsorted(at, ends - lengths), np.searchsorted(at, ends)
        if at[-1] != ends[-1] or (at[first] != ends - lengths).any() or (at[last] != ends).any():
            return pa.array(self.encode(texts), pa.large_binary())  # tokens do not spell the text byte by byte
        ids, to = np.delete(ids, last[gaps > 0]), np.cumsum(np.append(0, last - first)) * 4
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(to), pa.py_buffer(ids)])

    def places(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The bytes of texts that begin at ``starts`` at which pieces begin."""
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[starts] = True  # empty texts begin where the next one does
        begins[n] = True
        inside = ~begins
        marks = np.frombuffer(data.tobytes().translate(self.marks), np.uint8)
        seen = (marks & 1) == 0
        # White space of several bytes: its first and last bytes.
        for width, rare in ((2, marks & 32), (3, marks & 64)):
            first = np.flatnonzero(rare != 0)
            code = np.zeros(len(first), np.int64)
            for i in range(width):
                code = (code << 8) | data[first + i]
            first = first[np.isin(code, SPACES[width])]
            seen[first] = seen[first + width - 1] = False
        between = np.zeros(n, bool)
        between[1:-1] = seen[:-2] & seen[2:]
        between &= inside[:n]
        between &= inside[1:]
        feeds = between & ((marks & 4) != 0)
        between &= (marks & 2) != 0
        # Letters: those of ASCII, U+00C0 to U+027F but for two signs, and U+0400 to U+047F.
        letters = (marks[:-1] & 16) != 0
        letters[1:] |= ((marks[:-2] & 128) != 0) & ~((data[:-2] == 0xC3) & ((data[1:-1] == 0x97) | (data[1:-1] == 0xB7)))
        begins[:n] |= between
        begins[:n] |= feeds
        begins[1:] |= feeds
        begins[1:n] |= letters & ((marks[1:] & 8) != 0) & inside[1:n]
        return np.flatnonzero(begins[:n])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null), one after another, and how many each has."""
        if not self.cuts:
            coded = self.encode(texts.to_pylist())
            return np.frombuffer(b"".join(coded), "<u4"), np.array([len(c) // 4 for c in coded], np.int64)
        if len(self) > self.most // 2 or self.known.nbytes + self.known_ids.nbytes > 64 << 20:
            self.before, self.before_ids = self.known, self.known_ids
            self.known, self.known_ids = self.known[:0], self.known_ids[:0]
        texts = texts.cast(pa.large_binary())
        _, offsets, buffer = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if offsets[-1] == offsets[0]:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        data, starts = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
        begins, last = [], 0
        while last < len(texts):  # texts of about 256 KB at a time, which stay in a core's cache
            first, last = last, max(last + 1, int(np.searchsorted(starts, starts[last] + (256 << 10), "right")) - 1)
            a, b = starts[first], starts[last]
            if a < b:
                begins.append(self.places(data[a:b], starts[first:last] - a) + a)
        begins = np.concatenate([*begins, [len(data)]])
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(data)])
        pieces = pieces.dictionary_encode()
        found = self.of_pieces(pieces.dictionary).take(pieces.indices)
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] // 4
        return np.frombuffer(found.buffers()[2], "<u4")[: ends[-1]], np.diff(ends[np.searchsorted(begins, starts)])

    def of_pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of different pieces."""
        places = pc.index_in(pieces, self.known).fill_null(-1).to_numpy(zero_copy_only=False).copy()
        at = np.flatnonzero(places < 0)
        unknown = pieces.take(pa.array(at))
        again = pc.index_in(unknown, self.before)
        moved = again.is_valid()
        new = unknown.filter(again.is_null())
        new_ids = self.encode_new(new)
        # Known pieces come first, then those that move on, then new ones.
        order = np.argsort(again.is_null().to_numpy(zero_copy_only=False), kind="stable")
        places[at[order]] = len(self) + np.arange(len(at))
        known_ids = pa.concat_arrays([self.known_ids, self.before_ids.take(again.drop_null())])
        self.known = pa.concat_arrays([self.known, unknown.filter(moved)])
        kept = pc.less_equal(pc.binary_length(new), self.longest)
        self.known, self.known_ids = pa.concat_arrays([self.known, new.filter(kept)]), pa.concat_arrays([known_ids, new_ids.filter(kept)])
        return pa.concat_arrays([known_ids, new_ids]).take(pa.array(places))

    def encode_new(self, pieces: pa.Array) -> pa.Array:
        """The ids of different pieces from the library."""
        # White space at an end is that of a text, or belongs to a run of it.
        texts = pieces.cast(pa.large_string()).to_pylist()
        kinds = [2 if p[-1].isspace() else (p[1].isspace() * 2 if p[0] == " " else 1 + p[0].isspace()) for p in texts]
        order = np.argsort(kinds, kind="stable")
        one, two = np.searchsorted(np.array(kinds)[order], (1, 2))
        pieces = pieces.take(pa.array(order))
        inner, first, others = pieces[:one], pieces[one:two], pieces[two:].cast(pa.large_string()).to_pylist()
        coded = [self.encode_pieces(inner), self.encode_pieces(first, "\n"), pa.array(self.encode(others), pa.large_binary())]
        return pa.concat_arrays(coded).take(pa.array(np.argsort(order)))

    def of(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text."""
        ids, lengths = self.ids(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), (np.cumsum(lengths) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def tokens(text: str) -> Tokens:
    return Tokens(text)


def sized(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of texts, a row at least."""
    filled = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = filled[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(filled, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0, segment_ids: int = BLOCK * LANES) -> None:
    """Tokenize ``docs`` (``doc_id``, ``text``) and write their ids under ``path`` in ascending ``doc_id`` order.

    Every document ends with ``end_id``. Null ids come first; rows with equal ids are ordered by their texts; null
    and empty texts have the end alone. A document lies in one segment however long it is.
    """
    content = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = tokens(content.value), TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, ids, held
            segment = pack(doc_ids, lengths, np.concatenate(ids))
            arrays = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([segment], pa.binary())]
            doc_ids, lengths, ids, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(arrays, ["part", "segment", "n_ids", "content"])

        for batch in batches:
            for rows in sized(batch, 1, 32 << 20):
                found, numbers = encoder.ids(rows.column(1).fill_null(""))
                ends = np.cumsum(numbers)
                found, ends = np.insert(found, ends, end_id), (ends + np.arange(1, len(ends) + 1)).tolist()
                for doc_id, a, b in zip(rows.column(0).to_pylist(), [0, *ends], ends):
                    own = found[a:b]
                    doc_ids.append(doc_id)
                    lengths.append(len(own))
                    ids.append(own)
                    held += len(own)
                    if held >= segment_ids:
                        yield close()
                        number += 1
        if doc_ids:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, segment int, n_ids bigint, content binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files under ``path``: ``doc_id, start, ids``.

    ``start`` counts the ids of all documents before it; ``ids`` is binary, an unsigned little-endian 32-bit number
    each. The windows see one row per part, and the segments of one part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, content in zip(*batch.columns):
                doc_ids, lengths, ids = unpack(content.as_py())
                begins = np.cumsum(lengths) - lengths
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(lengths), [None, pa.py_buffer(np.r_[begins, len(ids)] * 4), pa.py_buffer(ids.astype("<u4"))]
                )
                for at in range(0, len(lengths), 1000):
                    rows = slice(at, at + 1000)
                    n = len(lengths[rows])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int32()),
                            pa.array(doc_ids[rows], pa.int64()), pa.array(begins[rows], pa.int64()), data.slice(at, 1000).cast(pa.binary()),
                        ],
                        ["part", "segment", "doc_id", "begin", "ids"],
                    )

    files = spark.read.parquet(path)
    found = files.select("part", "segment", "content").mapInArrow(run, "part int, segment int, doc_id bigint, begin bigint, ids binary")
    before = lambda window: F.sum("n_ids").over(window) - F.col("n_ids")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select(F.col("part").alias("_part"), before(Window.orderBy("part")).alias("parts_before"))
    segments = files.select("part", "segment", before(Window.partitionBy("part").orderBy("segment")).alias("segments_before"))
    offsets = segments.join(parts, F.col("part") == F.col("_part")).select(
        F.col("part").alias("_part"), F.col("segment").alias("_segment"), (F.col("parts_before") + F.col("segments_before")).alias("before")
    )
    joined = found.join(small(offsets, 500_000), (F.col("part") == F.col("_part")) & (F.col("segment") == F.col("_segment")))
    return joined.select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "ids")


def filed(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """``docs`` written as token files and read back; an empty table gives no rows."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write(docs, vocabulary, path)
    return read(spark, path)
