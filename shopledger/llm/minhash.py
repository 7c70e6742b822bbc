"""Near-duplicate documents by one-permutation MinHash with optimal densification.

One hash per shingle fills all bins: a bin holds the smallest hash that falls into it, and an empty bin takes the
value of the first filled bin in an order of its own (optimal densification). Rows of bins make bands, bands make
buckets, and a bucket gives one candidate edge per member, to its smallest document, so candidates grow with the
members of a bucket and not with its pairs. The edges only say which documents to compare: within each connected
cluster of candidates every pair that sizes allow is confirmed on the full shingle sets, in cells of a bounded size.
Texts with equal sets are one class from the start and are never expanded into pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import components, fresh, grouped, written

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of ``size`` words; A-Z are lower-cased.

    A text with fewer words has its whole sequence as one shingle; none without words.
    """
    # Bytes split at exactly the blank and the controls 9 to 13, and lower() changes A-Z alone.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(ids))
    total = np.full(len(ids) - width + 1, width, np.uint64)
    for i in range(width):
        total = total * MULTIPLIER + ids[i : len(ids) - width + 1 + i]
    return np.unique(mixed(total))


@lru_cache(maxsize=2)
def search_order(bins: int) -> np.ndarray:
    """For every bin the order in which it looks at the others when it is empty, as a random rank per other bin."""
    return np.random.default_rng(bins).random((bins, bins), dtype=np.float32)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of the densified one-permutation signature."""
    bins = bands * rows
    # Sorted hashes come in bin order, so the first of each bin is its smallest.
    at = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.r_[True, at[1:] != at[:-1]]
    filled = at[first]
    source = np.empty(bins, np.int64)
    source[filled] = np.flatnonzero(first)
    if len(filled) < bins:
        empty = np.ones(bins, bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        source[empty] = source[filled[search_order(bins)[np.ix_(empty, filled)].argmin(axis=1)]]
    values = hashes[source].reshape(bands, rows)
    total = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        total = total * MULTIPLIER + values[:, r]
    return mixed(total)


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Per row: ``doc_id, version`` (a hash of the text), ``n_shingles``, the fingerprint ``f1, f2`` of the shingle set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                counts, one, two, keys = [], [], [], []
                for text in part.column(1):
                    hashes = shingles(text.as_py(), size)
                    counts.append(len(hashes))
                    a, b = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)
                    one.append(a)
                    two.append(b)
                    keys.append(band_keys(hashes, bands, rows).view(np.int64) if len(hashes) else np.empty(0, np.int64))
                offsets = np.cumsum([0, *map(len, keys)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys))),
                    ],
                    names=["doc_id", "version", "n_shingles", "f1", "f2", "keys"],
                )

    schema = "doc_id bigint, version bigint, n_shingles bigint, f1 bigint, f2 bigint, keys array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text")).mapInArrow(run, schema)


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among ``sets``: pairs with ``100 * intersection >= percent * union``.

    ``side`` 0 and 1: only pairs across are compared; all 0: all pairs. Fewer links than pairs come out: one for
    each pair that is not yet connected through others.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    enough = lambda common, i, j: 100 * common >= percent * (sizes[i] + sizes[j] - common)
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if side.any() != side.all() and enough(common, 0, 1) or not side.any() and enough(common, 0, 1) else []
    # Rows of every shingle that occurs in two sets or more, one after another.
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(np.concatenate(sets), kind="stable")
    value, owner = np.concatenate(sets)[order], owner[order]
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    lengths = np.diff(np.r_[starts, len(value)])
    shingle = np.repeat(np.arange(len(starts)), lengths)
    shared = lengths[shingle] > 1
    by_set = np.argsort(owner[shared], kind="stable")
    wanted, of = shingle[shared][by_set], owner[shared][by_set]
    bounds = np.searchsorted(of, np.arange(n + 1))
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(n):
        mine = wanted[bounds[i] : bounds[i + 1]]
        if not len(mine) or (side.any() and side[i] == 1):
            continue
        many = lengths[mine]
        ends = np.cumsum(many)
        rows = np.arange(ends[-1]) + np.repeat(starts[mine] - ends + many, many)
        common = np.bincount(owner[rows], minlength=n)
        good = np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common))
        for j in good.tolist():
            if (side[j] == 1 if side.any() else j > i) and find(i) != find(j):
                root[find(j)] = find(i)
                links.append((i, j))
    return links


def confirmed_links(docs: DataFrame, clusters: DataFrame, classes: DataFrame, size: int, percent: int, cell: int) -> DataFrame:
    """Links ``a, b`` that connect all linked classes of each cluster ``(id, component)``.

    ``classes`` names a row of ``docs`` for each class: ``node`` (its id in the links), ``rep, version, n_shingles``.
    A cluster of up to ``cell`` shingles is one cell. Larger ones are cut by set size into classes, of which only
    the same or the next can hold links, and classes into tiles of about ``cell`` shingles; every pair of tiles
    that may hold links is a cell.
    """
    members = clusters.join(classes.select(F.col("node").alias("id"), "rep", "version", "n_shingles"), "id")
    totals = members.groupBy("component").agg(F.sum("n_shingles").alias("total"))
    members = members.join(totals, "component")
    base = 101.0 / percent
    members = members.withColumn(
        "class", F.when(F.col("total") <= cell, F.lit(0)).otherwise(F.floor(F.ln("n_shingles") / math.log(base)).cast("int"))
    )
    tiles = members.groupBy("component", "class").agg(F.ceil(F.sum("n_shingles") / cell).cast("int").alias("tiles"))
    tiles = written(tiles, "tiles")
    near = lambda name, step: tiles.select(
        "component", (F.col("class") + step).alias("class"), F.col("tiles").alias(name)
    )
    placed = members.join(tiles, ["component", "class"]).join(near("above", -1), ["component", "class"], "left")
    placed = placed.join(near("below", 1), ["component", "class"], "left")
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))

    def cells(other: Column, low_class: Column, mine_low: bool) -> Column:
        count = F.coalesce(other, F.lit(0))
        all_of = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        pair = lambda j: (F.col("tile"), j) if mine_low else (j, F.col("tile"))
        return F.transform(
            all_of,
            lambda j: F.struct(
                low_class.alias("class"), F.lit(1).alias("across"), pair(j)[0].alias("i"), pair(j)[1].alias("j"),
                F.lit(0 if mine_low else 1).alias("side"),
            ),
        )

    own = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda j: F.struct(
            F.col("class").alias("class"), F.lit(0).alias("across"), F.least(F.col("tile"), j).alias("i"),
            F.greatest(F.col("tile"), j).alias("j"), (F.col("tile") > j).cast("int").alias("side"),
        ),
    )
    every = F.concat(own, cells(F.col("above"), F.col("class"), True), cells(F.col("below"), F.col("class") - 1, False))
    rows = placed.select("id", "component", "rep", "version", F.explode(every).alias("c"))
    rows = rows.select(
        "id", "rep", "version", F.xxhash64("component", "c.class", "c.across", "c.i", "c.j").alias("cell"),
        F.col("c.side").alias("side"),
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), F.xxhash64("text").alias("version"), "text")
    rows = rows.join(texts, ["rep", "version"]).select("cell", "id", "side", "text")

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        if table.num_rows < 2:
            return None
        ids = table.column("id").to_numpy()
        sets = [shingles(t.as_py(), size) for t in table.column("text").chunk(0)]
        links = linked(sets, table.column("side").to_numpy(), percent)
        if not links:
            return None
        a, b = np.array(links).T
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return grouped(rows, ["cell"], compare, "a bigint, b bigint")


def judged(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 64, rows: int = 6, cell: int = 400_000) -> DataFrame:
    """Per row of ``docs``: ``doc_id, version, n_shingles, component_id`` and ``winner``.

    The nodes of the links are classes of equal shingle sets, named by the first half of their fingerprint, so rows of
    one id with different texts are different nodes. ``winner`` is the smallest ``(doc_id, version)`` of the group, null
    for rows without a set or an id.
    """
    signed = written(signatures(docs, size, bands, rows), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    named = F.min(F.struct("doc_id", "version")).alias("first")
    classes = filled.groupBy("f1", "f2").agg(named, F.max("n_shingles").alias("n_shingles"))
    classes = classes.select(
        "f1", "f2", F.col("f1").alias("node"), F.col("first.doc_id").alias("rep"), F.col("first.version").alias("version"), "n_shingles"
    )
    classes = written(classes, "classes")
    chosen = classes.select("f1", "f2", "node", "rep", F.col("version").alias("chosen"))
    first = filled.join(chosen, ["f1", "f2"]).where("doc_id = rep and version = chosen").select("node", F.explode("keys").alias("key"))
    buckets = written(first.distinct(), "buckets")
    centers = buckets.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("other")).where("center < other")
    stars = buckets.join(centers.select("key", "center"), "key").where("node != center")
    clusters = components(stars.select(F.col("node").alias("a"), F.col("center").alias("b")))
    links = confirmed_links(docs, clusters, classes, size, percent, cell)
    found = components(links).select(F.col("id").alias("node"), "component")
    of = classes.join(found, "node", "left").select(
        "f1", "f2", F.coalesce("component", "node").alias("component"), F.struct(F.col("rep").alias("doc_id"), "version").alias("first")
    )
    best = of.groupBy("component").agg(F.min("first").alias("winner"))
    reached = of.join(best, "component").select("f1", "f2", "winner")
    bare = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull()
    joined = signed.select("doc_id", "version", "n_shingles", "f1", "f2", bare.alias("bare")).join(reached, ["f1", "f2"], "left")
    winner = F.when(~F.col("bare"), F.col("winner"))
    return joined.select(
        "doc_id", "version", "n_shingles", F.when(F.col("bare"), F.col("doc_id")).otherwise(F.col("winner.doc_id")).alias("component_id"),
        winner.alias("winner"),
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Groups of near-duplicates: ``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of ``size``-word shingles, on
    the full sets (as 64-bit hashes). ``component_id`` is the smallest ``doc_id`` reachable over links, itself
    included; ``kept`` marks it. With the default bands a pair at a similarity of 0.8 shares no bucket with a
    probability of 4e-9. ``options`` are those of ``judged``.

    Null and empty texts have an empty set and no links. A null id is linked with nothing; its row is kept. Rows
    with equal ids are judged by their own texts, which may be in different groups. Classes of equal sets are told
    apart by 64-bit hashes in the links. An empty table gives no rows.
    """
    return judged(docs, **options).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, of its smallest ``doc_id``.

    Rows of one id whose texts are in different groups stay apart. Of rows equal in id and text one stays; rows with
    a null id all stay.
    """
    gone_id, gone, spread, row, version = (fresh(name, docs) for name in ("_gone_id", "_gone", "_spread", "_row", "_version"))
    lost = judged(docs, **options).where("struct(doc_id, version) != winner")
    lost = lost.select(F.col("doc_id").alias(gone_id), F.col("version").alias(gone)).distinct()
    marked = docs.withColumn(version, F.xxhash64("text"))
    left = marked.join(lost, (F.col("doc_id") == F.col(gone_id)) & (F.col(version) == F.col(gone)), "left_anti")
    left = left.withColumn(spread, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    first = F.row_number().over(Window.partitionBy("doc_id", version, spread).orderBy("text"))
    return left.withColumn(row, first).where(F.col(row) == 1).drop(spread, row, version)
