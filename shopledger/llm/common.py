"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of characters other than the space and the ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and readable when executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, df: DataFrame) -> str:
    """``name`` with as many underscores before it as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``rows`` rows; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def chunks(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """The texts of a batch in pieces of about ``size`` characters, with the row at which each begins."""
    held, start, length = [], 0, 0
    for i, text in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
        held.append(text)
        length += len(text or "")
        if length >= size:
            yield start, held
            held, start, length = [], i + 1, 0
    if held:
        yield start, held


def grouped(df: DataFrame, keys: Sequence[str], function: Callable[[dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``function`` to each group's columns (name to Arrow array) by streaming over sorted partitions.

    For groups of a bounded size. Cheaper than ``applyInPandas`` where most groups are a few rows. ``keys`` are
    longs without nulls.
    """
    placed = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def finish():
            got = function(pa.Table.from_batches(held).combine_chunks())
            held.clear()
            return got

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys])
            starts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                key = tuple(ids[:, start])
                if held and key != last:
                    if (out := finish()) is not None:
                        yield out
                held.append(batch.slice(start, end - start))
                last = key
        if held and (out := finish()) is not None:
            yield out

    return placed.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected links ``(a, b)`` (longs): ``id, component``, the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links form stars. Each round is
    one table in the shared folder. Ids without a link, and null or self links, are left out. An empty input gives
    an empty result.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    links = edges.where("a != b").select(larger.alias("x"), smaller.alias("y")).distinct()
    links, before = written(links, "links"), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = links.union(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        wide = both.join(least, "x").where("y > x and y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        wide = wide.distinct()
        near = wide.groupBy("x").agg(F.min("y").alias("m"))
        moved = wide.join(near, "x").where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        links = written(moved.union(near.select("x", F.col("m").alias("y"))).distinct(), "links")
    return links.select(F.col("x").alias("id"), F.col("y").alias("component")).union(
        links.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct()
    )
