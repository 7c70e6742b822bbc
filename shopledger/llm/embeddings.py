"""Embedding near-duplicates: tiles of vectors in principal-component order, compared with early stops.

Vectors are scaled to length one and turned into the basis of their principal components, so that the leading
dimensions hold most of every product. Vectors of a label are ordered along the first component and cut into tiles.
A pair of tiles is skipped if their boxes in the leading components are too far apart for the threshold. Otherwise
products are summed over a few dimensions at a time; after each step a pair is dropped when its sum plus the product
of the two vectors' remaining norms (Cauchy-Schwarz) cannot reach the threshold. What is left is decided by the
cosine of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, grouped, written

#: Rounding room of the rotated products; only the exact cosine decides.
ROOM = 1e-6


def matrix(batch, column: str) -> list[np.ndarray]:
    return [np.asarray(v.as_py(), dtype=np.float64) for v in batch.column(column)]


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length, the principal axes (columns) of the unit vectors' second moments, largest first.

    Each task adds up its own moments; the driver gets one matrix per length.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.to_pydict()["embedding"]
            by_length: dict[int, list] = {}
            for row in rows:
                by_length.setdefault(len(row), []).append(row)
            for length, group in by_length.items():
                x = np.array(group, dtype=np.float64)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                sums[length] = sums.get(length, 0) + x.T @ x
        for length, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"n": [length] * length, "i": list(range(length)), "row": [list(map(float, r)) for r in total]},
                schema=pa.schema([("n", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))]),
            )

    rows = vectors.select("embedding").mapInArrow(moments, "n int, i int, row array<double>")
    sums = rows.select("n", "i", F.posexplode("row").alias("j", "v")).groupBy("n", "i", "j").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r.n, np.zeros((r.n, r.n)))[r.i, r.j] = r.v
    return {n: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for n, m in found.items()}


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of corresponding rows, from the original components in double precision."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` (rotated unit vectors) whose product may reach the threshold, with early stops."""
    dims = x.shape[1]
    left = lambda z: np.sqrt(np.maximum(0, 1 - np.cumsum(z * z, axis=1)))  # noqa: E731  norms of what follows
    rest_x, rest_y = left(x), left(y)
    sums = x[:, :step] @ y[:, :step].T
    at = min(step, dims)
    a, b = np.nonzero(sums + np.outer(rest_x[:, at - 1], rest_y[:, at - 1]) >= threshold - ROOM)
    sums = sums[a, b]
    while at < dims and len(a):
        to = min(at + step, dims)
        sums = sums + np.einsum("ij,ij->i", x[a, at:to], y[b, at:to])
        keep = sums + rest_x[a, to - 1] * rest_y[b, to - 1] >= threshold - ROOM
        a, b, sums, at = a[keep], b[keep], sums[keep], to
    return a, b


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = 512, boxed: int = 4) -> DataFrame:
    """Groups of close vectors: ``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Reads ``vec_id, embedding, label``. Vectors of equal labels and lengths are linked if their cosine is at least
    ``threshold``. Null, empty and zero vectors, vectors with null or non-finite components, and rows with a null
    label or id have no links. Equal vectors are one class, compared once and counted with their number; rows with
    equal ids count one by one. Within a pair of tiles links are counted per vector and only a spanning set of them
    is passed on for the components. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    value = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda v: F.coalesce(value(v), F.lit(False)))
        & F.exists("embedding", lambda v: v != 0)
    )
    usable = F.coalesce(good, F.lit(False))
    classes = rows.where(usable).groupBy("label", "embedding").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")
    )
    classes = written(classes, "vectors")
    axes = classes.sparkSession.sparkContext.broadcast(principal_axes(classes))

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = []
            for v in matrix(batch, "embedding"):
                turned.append((v / np.sqrt((v * v).sum())) @ axes.value[len(v)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([t[:boxed].tolist() for t in turned], pa.list_(pa.float64()))],
                names=[*batch.schema.names, "lead"],
            )

    kind = rows.schema["label"].dataType.simpleString()
    schema = f"label {kind}, embedding {rows.schema['embedding'].dataType.simpleString()}, id bigint, copies bigint, lead array<double>"
    led = classes.mapInArrow(rotate, schema).withColumn("space", F.xxhash64("label", F.size("embedding")))
    # Tiles: slabs along the first component, cut further by a hash where a slab has many vectors.
    reach = float(np.sqrt(2 - 2 * threshold)) + ROOM
    led = led.withColumn("slab", F.floor(F.get("lead", F.lit(0)) / (reach / 2)))
    counts = led.groupBy("space", "slab").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    led = led.join(counts, ["space", "slab"]).withColumn("tile", F.xxhash64("slab", F.pmod(F.xxhash64("id"), F.col("parts"))))
    led = written(led.drop("parts"), "tiles")
    lows = [F.min(F.get("lead", F.lit(i))).alias(f"low{i}") for i in range(boxed)]
    highs = [F.max(F.get("lead", F.lit(i))).alias(f"high{i}") for i in range(boxed)]
    boxes = written(led.groupBy("space", "slab", "tile").agg(*lows, *highs), "boxes")
    # A slab is half as wide as the reach, so links lie within a slab or between it and the next two.
    ahead = F.explode(F.array(*[F.col("slab") + i for i in range(3)])).alias("at")
    one, two = boxes.select("*", ahead).alias("p"), boxes.alias("q")
    gap = lambda i: F.coalesce(F.greatest(
        F.lit(0.0), F.col(f"p.low{i}") - F.col(f"q.high{i}"), F.col(f"q.low{i}") - F.col(f"p.high{i}")
    ), F.lit(0.0))
    apart = sum((gap(i) * gap(i) for i in range(boxed)), F.lit(0.0))
    pairs = one.join(two, (F.col("p.space") == F.col("q.space")) & (F.col("p.at") == F.col("q.slab")))
    pairs = pairs.where((F.col("p.slab") < F.col("q.slab")) | (F.col("p.tile") <= F.col("q.tile"))).where(apart <= reach * reach).select(
        F.col("p.space").alias("space"), F.col("p.tile").alias("p"), F.col("q.tile").alias("q")
    )
    cell = F.xxhash64("space", "p", "q").alias("cell")
    sides = pairs.select("space", F.col("p").alias("tile"), cell, F.lit(0).alias("side")).unionAll(
        pairs.where("p != q").select("space", F.col("q").alias("tile"), cell, F.lit(1).alias("side"))
    )
    placed = sides.join(led.drop("slab"), ["space", "tile"]).select("cell", "side", "id", "copies", "embedding")

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        x = np.array(table.column("embedding").to_pylist(), dtype=np.float64)
        turned = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ axes.value[x.shape[1]]
        side = table.column("side").to_numpy()
        mine, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(others)
        if same:
            others = mine
        if not len(mine):
            return None
        a, b = close_pairs(turned[mine], turned[others], threshold)
        if same:
            a, b = a[a < b], b[a < b]
        a, b = mine[a], others[b]
        good = np.zeros(len(a), bool)
        for start in range(0, len(a), 1 << 18):
            part = slice(start, start + (1 << 18))
            good[part] = cosines(x[a[part]], x[b[part]]) >= threshold
        a, b = a[good], b[good]
        if not len(a):
            return None
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        root = list(range(len(ids)))

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for i, j in zip(a.tolist(), b.tolist()):
            p, q = find(i), find(j)
            if p != q:
                if ids[p] > ids[q]:
                    p, q = q, p
                root[q] = p
        held = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[held]), pa.array(links[held].astype(np.int64)), pa.array(ids[[find(int(v)) for v in held]])],
            names=["id", "links", "root"],
        )

    found = written(grouped(placed, ["cell"], compare, "id bigint, links bigint, root bigint"), "cells")
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("id").agg(F.sum("links").alias("links")).join(linked, "id", "left")
    per_class = classes.join(totals, "id", "left").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "id").alias("_component"),
    )
    key = usable & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))
    joined = rows.join(per_class, key, "left").select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("_component", "vec_id").alias("component_id"),
    )
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
