"""Two tokenizers' ids of the same texts, cut into groups at the bytes where tokens of both end.

For each text the cumulative byte ends of both id lists become dictionaries from end to index; the ends that both have,
sorted, slice the lists into groups, and each slice is expanded to its links. How many documents have an id pair linked
is counted over the corpus and looked up for every document.

Most of a corpus is repeated words, so texts are cut before every blank that has a visible character on either side,
where both tokenizers end a token in any case, and each distinct piece is aligned once per worker while it is in use.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain, filterfalse
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import chunks, written

#: The mark that stands for a blank in pieces.
BLANK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: visible Latin-1 stands for itself, other bytes for
    the characters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(other)}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a piece; ``<0x41>`` is one byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes.fromhex(piece[3:5])
    return piece.replace(BLANK, " ").encode()


def cuts(ends_a: Sequence[int], ends_b: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """The ends that both id lists have, and how many ids of each list lie before them."""
    index_a, index_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(index_a.keys() & index_b.keys())
    return common, list(map(index_a.__getitem__, common)), list(map(index_b.__getitem__, common))


class Aligner(dict):
    """Alignments of pieces of text, kept up to a bound: numbers of a, b, groups, links; groups as text; linked pairs.

    Half of the bound are pieces used of late, ``before`` the half that was so until then; what comes again moves on.
    """

    def __init__(self, byte_level: str, pieces: bytes, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.most = Tokenizer.from_str(byte_level), SentencePieceProcessor(model_proto=pieces), most
        self.before: dict[str, tuple] = {}
        self.a.encode_special_tokens = True
        letters = byte_alphabet()
        names = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        self.bytes_a = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for i, t in names}
        vocabulary = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [piece_bytes(p) for p in vocabulary]
        self.sizes_a, self.sizes_b = {i: len(x) for i, x in self.bytes_a.items()}, [len(x) for x in self.bytes_b]
        self.most_id = max(*self.bytes_a, len(vocabulary)) + 1
        self.signed = [f"{i}{sign}" for sign in ",|;" for i in range(self.most_id)]
        split = json.loads(byte_level)["pre_tokenizer"]
        cuts_a = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        # No piece goes on with a blank, so no merge crosses the place before one.
        self.cuts = cuts_a and not any(BLANK in p.lstrip(BLANK) for p in vocabulary)

    def align(self, texts: Sequence[str], together: int = 1) -> list[tuple | None]:
        """One alignment per text that begins with a blank; none where the tokens' bytes differ from the text's.

        The texts are aligned as one long text: each ends where tokens of both end. So many ``together`` are one text
        for A too, if A ends a token between them in any case.
        """
        parts = texts if together == 1 else ["".join(texts[i : i + together]) for i in range(0, len(texts), together)]
        ids_a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        data = [t.encode() for t in texts]
        kept = range(len(texts))
        if together > 1:
            if not self.spelled(self.bytes_a, ids_a) == self.spelled(self.bytes_b, ids_b) == b"".join(data):
                return self.align(texts)
            return list(self.grouped(ids_a, ids_b, list(map(len, data))))
        if not self.spelled(self.bytes_a, ids_a) == self.spelled(self.bytes_b, ids_b) == b"".join(data):
            same = lambda i: self.spelled(self.bytes_a, [ids_a[i]]) == self.spelled(self.bytes_b, [ids_b[i]]) == data[i]
            kept = [i for i in kept if same(i)]
        found: list[tuple | None] = [None] * len(texts)
        for i, alignment in zip(kept, self.grouped([ids_a[i] for i in kept], [ids_b[i] for i in kept], [len(data[i]) for i in kept])):
            found[i] = alignment
        return found

    @staticmethod
    def spelled(spelling, ids: Sequence[Sequence[int]]) -> bytes:
        return b"".join(map(spelling.__getitem__, chain.from_iterable(ids)))

    def grouped(self, ids_a: Sequence[Sequence[int]], ids_b: Sequence[Sequence[int]], lengths: Sequence[int]) -> Iterator[tuple]:
        """The alignments of texts of so many bytes from their ids."""
        a, b = list(chain.from_iterable(ids_a)), list(chain.from_iterable(ids_b))
        if not a:
            return
        ends = [list(accumulate(map(s.__getitem__, ids))) for s, ids in ((self.sizes_a, a), (self.sizes_b, b))]
        common, to_a, to_b = (np.array(x, np.int64) for x in cuts(*ends))
        from_a, from_b = np.r_[0, to_a[:-1]], np.r_[0, to_b[:-1]]
        n_a, n_b, a, b = to_a - from_a, to_b - from_b, np.array(a, np.int64), np.array(b, np.int64)

        # Every id with the sign that follows it, group by group: first those of a, then those of b.
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[to_a - 1], sign_b[to_b - 1] = 1, 2
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(from_b, n_a)] = a + sign_a * self.most_id
        order[np.arange(len(b)) + np.repeat(to_a, n_b)] = b + sign_b * self.most_id
        signed = list(map(self.signed.__getitem__, order.tolist()))

        links = n_a * n_b
        group = np.repeat(np.arange(len(common)), links)
        place = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
        linked = a[from_a[group] + place // n_b[group]] << 32 | b[from_b[group] + place % n_b[group]]
        pairs = linked.tolist()

        groups_to = np.searchsorted(common, np.cumsum(lengths), "right")
        if (common[groups_to - 1] != np.cumsum(lengths)).any():
            raise ValueError("a token goes beyond the end of its text")
        ids_to = [np.r_[0, x[groups_to - 1]] for x in (to_a, to_b, np.arange(1, len(common) + 1), np.cumsum(links))]
        numbers = [np.diff(x).tolist() for x in ids_to]
        text_to, pairs_to = (ids_to[0] + ids_to[1]).tolist(), ids_to[3].tolist()
        texts = ["".join(signed[i:j])[:-1] for i, j in zip(text_to, text_to[1:])]
        yield from zip(*numbers, texts, [tuple(pairs[i:j]) for i, j in zip(pairs_to, pairs_to[1:])])

    def of(self, texts: Sequence[str | None]) -> list[list[tuple] | None]:
        """The alignments of the pieces of each text; none for a text without tokens."""
        # Nothing here makes a cycle, but many small objects would have the kept ones searched for cycles again and again.
        enabled = gc.isenabled()
        gc.disable()
        try:
            return self.looked_up(texts)
        finally:
            if enabled:
                gc.enable()

    def looked_up(self, texts: Sequence[str | None]) -> list[list[tuple] | None]:
        if len(self) > self.most // 2:
            self.before = dict(self)
            self.clear()
        before, new = self.before, set()
        cut: list[list[str] | None] = []
        for text in texts:
            parts = f" {text}".replace(" ", "\0 ").split("\0")[1:] if text and self.cuts and "\0" not in text and BLANK not in text else None
            if parts:
                missing = set(filterfalse(self.__contains__, parts))
                if again := list(filter(before.__contains__, missing)):
                    self.update(zip(again, map(before.__getitem__, again)))
                    missing.difference_update(again)
                for p in missing:
                    if len(p) < 2 or p[1].isspace() or p[-1].isspace():
                        parts = None  # a run of white space, which the tokenizers may join
                        break
                else:
                    new |= missing
            cut.append(parts)
        pieces = list(new)
        self.update(zip(pieces, self.align(pieces, 1000)))
        result: list = []
        whole = []
        for i, (text, parts) in enumerate(zip(texts, cut)):
            found = list(map(self.__getitem__, parts)) if parts else [None]
            result.append(None if None in found else found)
            if result[-1] is None and text:
                whole.append(i)
        for i, alignment in zip(whole, self.align([f" {texts[i]}" for i in whole])):
            result[i] = None if alignment is None else [alignment]
        for p in [p for p in pieces if len(p) > 100 or self[p] is None]:
            del self[p]
        return result


@lru_cache(maxsize=1)
def aligner(byte_level: str, pieces: bytes) -> Aligner:
    return Aligner(byte_level, pieces)


def alignments(documents: DataFrame, byte_level: str, pieces: str, groups: bool = False) -> DataFrame:
    """Each document's numbers, its groups' hash (and text), and its distinct linked pairs with how often they occur."""
    vocabularies = documents.sparkSession.sparkContext.broadcast((Path(byte_level).read_text("utf-8"), Path(pieces).read_bytes()))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = aligner(*vocabularies.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, texts in chunks(batch, "text", 1 << 20):
                numbers, hashes, written, pairs, times = [], [], [], [], []
                for found in known.of(texts):
                    if found is None:
                        numbers.append((0, 0, 0, 0))
                        text, own, often = "", np.empty(0, np.int64), np.empty(0, np.int64)
                    else:
                        *sums, parts, codes = zip(*found)
                        numbers.append(tuple(map(sum, sums)))
                        text = ";".join(parts)
                        own, often = np.unique(np.fromiter(chain.from_iterable(codes), np.int64), return_counts=True)
                    hashes.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
                    written.append(text if groups else None)
                    pairs.append(own)
                    times.append(often)
                offsets = pa.array(np.r_[0, np.cumsum([len(p) for p in pairs])], pa.int32())
                counts = np.array(numbers, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(texts))), batch.column(0).slice(at, len(texts)),
                        *[pa.array(counts[:, i].copy()) for i in range(4)], pa.array(hashes, pa.string()), pa.array(written, pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs))),
                        pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times).astype(np.int32))),
                    ],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"],
                )
                row += len(texts)

    schema = f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pairs array<bigint>, times array<int>"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, n, best``: how many documents have a pair linked, and whether no pair of its first id has more."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = written(counts, "pairs")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    joined = counts.join(most, F.shiftright("pair", 32) == F.col("a"))
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The pairs of the highest counts, by powers of two, as many as stay within ``most``."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r["p"]: r["c"] for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect()}
    least, total = 64, 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > most:
            break
        least = p
    return counts.where(power >= least)


def aligned(documents: DataFrame, byte_level: str, pieces: str, groups: bool = False, most: int = 1 << 20) -> DataFrame:
    """How the ids of a byte-level vocabulary (A) and of a piece model (B) align in each of ``documents``.

    One row per row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups``. A link is an A
    and a B token of one group; a pair of ids counts the documents that have it linked. ``n_best`` counts the links
    whose pair has the highest count of its A id, ``count_sum`` adds the counts of all links. ``groups`` is null unless
    asked for. A text that is null, empty, or not given back byte by byte by both vocabularies has zeros and an empty
    hash. Rows of equal ids or texts count as documents each; other columns are not read.

    Workers get the ``most`` most frequent pairs at most; documents' other pairs are joined to the rest of the counts,
    of which none is frequent.
    """
    found = written(alignments(documents, byte_level, pieces, groups), "alignments")
    counts = written(pair_counts(found), "pair-counts")
    top = frequent(counts, most).orderBy("pair").toArrow()
    shared = documents.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    kind = documents.schema["doc_id"].dataType.simpleString()
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, bests = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            sums = lambda values: np.diff(np.r_[0, np.cumsum(values)][np.r_[0, ends]])
            n = numbers[at] * known if len(keys) else np.zeros(len(pairs), np.int64)
            best = bests[at] & known if len(keys) else known
            offsets = pa.array(np.r_[0, np.cumsum(~known)][np.r_[0, ends]], pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(v[~known])) for v in (pairs, times)]
            columns = [batch.column(c) for c in kept] + [pa.array(sums(best * times)), pa.array(sums(n * times)), *rest]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_best", "count_sum", "pairs", "times"])

    schema = f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"
    looked = found.mapInArrow(run, schema)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    if top.num_rows == counts.count():
        return looked.select(out)
    looked = written(looked, "looked-up")
    rest = looked.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    rest = rest.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times")).join(counts, "pair")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    joined = looked.join(rest, "row", "left")
    joined = joined.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
    return joined.withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).select(out)
