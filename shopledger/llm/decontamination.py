"""Passages of a benchmark in documents, found by winnowed fingerprints.

Words are compared after A-Z is lower-cased. A window is ``window`` consecutive words of an item, or the whole item if
it has fewer words. Of the hashes of ``gram`` words inside a window the smallest is its fingerprint (Schleimer,
Wilkerson and Aiken, 2003): equal windows have equal fingerprints wherever they are, so no shared passage of a window's
length is missed, while neighbouring windows mostly share theirs. A document's fingerprints that the benchmark may have
(a bit table of fixed size says so) are extended to the windows that chose them, and these are joined with the
benchmark's windows. Items of fewer words have windows and fingerprints of their own length, on both sides.

Words and windows are compared by 64-bit and 128-bit hashes. What is joined is one row per distinct text and window, so
thousands of copies of a text, or one passage in most documents, give no more rows than texts have words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import chunks, small, written

#: A-Z to a-z, and what is neither a letter, a digit nor beyond ASCII to a blank.
FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """Hashes of words, kept for words of moderate length up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 500_000:
                self.clear()
            self[word] = value
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash: every bit depends on all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def runs(hashes: np.ndarray, starts: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """One hash per run of ``length`` words beginning at ``starts``; the order of the words counts."""
    found = np.full(len(starts), length, np.uint64)
    for i in range(length):
        found = found * factor + hashes[starts + i]
    return mixed(found)


def fingerprints(hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The fingerprint of every window of ``length`` words: the smallest hash of ``gram`` words in it."""
    gram = min(gram, length)
    grams = runs(hashes, np.arange(len(hashes) - gram + 1), gram, FIRST)
    windows = len(hashes) - length + 1
    least = grams[:windows].copy()
    for i in range(1, length - gram + 1):
        np.minimum(least, grams[i : i + windows], out=least)
    return mixed(least + np.uint64(length))


class Words:
    """The word hashes of several texts in one array, and where each text ends."""

    def __init__(self, texts: Sequence[bytes | None], known: Hashes):
        self.folded = [(t or b"").translate(FOLDED) for t in texts]
        split = [f.split() for f in self.folded]
        self.lengths = np.array([len(s) for s in split], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        total = int(self.lengths.sum())
        self.hashes = np.fromiter(map(known.__getitem__, (w for s in split for w in s)), np.uint64, total)

    def windows(self, length: int, gram: int, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start in the whole array, and fingerprint of each window of ``length`` words of the chosen texts."""
        if len(self.hashes) < length:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
        prints = fingerprints(self.hashes, length, gram)
        per_text = np.where(texts, np.maximum(self.lengths - length + 1, 0), 0)
        text = np.repeat(np.arange(len(self.lengths)), per_text)
        start = np.arange(len(text)) + np.repeat(self.begins - (np.cumsum(per_text) - per_text), per_text)
        return text, start, prints[start]

    def window_hashes(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(runs(self.hashes, starts, length, f).view(np.int64) for f in (FIRST, SECOND))


def item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """``item, length, h1, h2, print``: the windows of all items; ``item`` is the id as text, ``null`` for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in chunks(batch, "text"):
                words = Words(texts, known)
                for length in sorted(set(np.minimum(words.lengths, window).tolist()) - {0}):
                    chosen = words.lengths == length if length < window else words.lengths >= window
                    text, start, prints = words.windows(length, gram, chosen)
                    h1, h2 = words.window_hashes(start, length)
                    for i in range(0, len(text), 100_000):
                        rows = slice(i, i + 100_000)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([ids[at + t] for t in text[rows].tolist()], pa.string()),
                                pa.array(np.full(len(text[rows]), length, np.int32)), pa.array(h1[rows]), pa.array(h2[rows]),
                                pa.array(prints[rows].view(np.int64)),
                            ],
                            ["item", "length", "h1", "h2", "print"],
                        )

    named = F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")
    chosen = benchmark.select(named, F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "item string, length int, h1 bigint, h2 bigint, print bigint").distinct()


def bit_table(windows: DataFrame, bits: int) -> np.ndarray:
    """Which remainders of ``2 ** bits`` the fingerprints have, a bit each; the driver gets ``2 ** (bits - 6)`` rows at most."""
    place = F.col("print").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr("shiftleft(1L, CAST(print & 63 AS INT))")
    found = windows.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return table.view(np.uint64)


def candidates(documents: DataFrame, lengths: Sequence[int], table: np.ndarray, gram: int) -> DataFrame:
    """``doc_id, n_words, k1, k2, found``: the windows of each text whose fingerprint the benchmark may have.

    ``k1, k2`` identify the text, ``found`` has ``start, length, h1, h2``.
    """
    shared = documents.sparkSession.sparkContext.broadcast(table)
    kind = documents.schema["doc_id"].dataType
    mask = np.uint64(len(table) * 64 - 1)
    fields = [("start", pa.int32()), ("length", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = Hashes(), shared.value
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                words, parts = Words(texts, known), []
                for length in lengths:
                    text, start, prints = words.windows(length, gram, np.ones(len(texts), bool))
                    # Neighbouring windows share their fingerprint mostly: each is looked up once.
                    new = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.empty(0, np.int64)
                    place = prints[new] & mask
                    known_print = (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
                    hit = np.repeat(known_print.astype(bool), np.diff(np.r_[new, len(prints)]))
                    text, start = text[hit], start[hit]
                    parts.append((text, start - words.begins[text], np.full(len(text), length), *words.window_hashes(start, length)))
                text, *columns = [np.concatenate(c) for c in zip(*parts)]
                order = np.argsort(text, kind="stable")
                offsets = np.r_[0, np.cumsum(np.bincount(text, minlength=len(texts)))]
                structs = pa.StructArray.from_arrays(
                    [pa.array(c[order]).cast(k) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields]
                )
                keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.folded)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), pa.array(words.lengths), pa.array(keys[:, 0].copy()),
                        pa.array(keys[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
                    ],
                    ["doc_id", "n_words", "k1", "k2", "found"],
                )

    schema = f"doc_id {kind.simpleString()}, n_words bigint, k1 bigint, k2 bigint, found array<struct<start:int,length:int,h1:bigint,h2:bigint>>"
    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, filter_bits: int = 24) -> DataFrame:
    """What of ``benchmark`` (``item_id, text``) occurs in each of ``documents`` (``doc_id, text``).

    One row per document: ``doc_id, n_words, n_hit`` (words inside an occurring window), ``spans`` (maximal runs of
    hit windows that touch or overlap, ``start`` to ``end`` in words, end exclusive), ``items`` (ids of the items with
    an occurring window, as text, sorted as text, each once), ``contaminated``. Texts that are null, empty or without
    words have no hits, and such items no windows; items with equal ids are one; a null id is named ``null``. Rows of
    equal ids or texts are each judged; other columns are not read. Without a benchmark nothing is hit. ``filter_bits``
    bounds what is broadcast (2 MB); a larger benchmark only lets more windows pass to the join.
    """
    windows = written(item_windows(benchmark, window, gram), "item-windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most ``window`` values
    if not lengths:
        lengths = [window]
    found = written(candidates(documents, lengths, bit_table(windows, filter_bits), gram), "candidates")

    several = found.where(F.size("found") > 0).select("k1", "k2", F.explode("found").alias("w"))
    distinct = several.select("k1", "k2", "w.*").distinct()
    hits = distinct.join(small(windows.select("h1", "h2").distinct(), 1_000_000), ["h1", "h2"])
    hits = written(hits, "hits")

    end = F.col("start") + F.col("length")
    by_start = Window.partitionBy("k1", "k2").orderBy("start", "length")
    reach = F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.select("k1", "k2", "start", "length", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int").alias("new"))
    numbered = opened.select("k1", "k2", "start", end.alias("end"), F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    spans = numbered.groupBy("k1", "k2", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("k1", "k2").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    items = hits.select("k1", "k2", "h1", "h2").distinct().join(small(windows.select("h1", "h2", "item"), 1_000_000), ["h1", "h2"])
    items = items.select("k1", "k2", "item").distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list("item")).alias("items"))
    texts = small(written(spans.join(items, ["k1", "k2"]), "hit-texts"), 200_000)
    return found.join(texts, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
