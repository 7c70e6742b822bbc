"""Distinct counts that can be added up over any grouping.

Exact: bitmaps over dense surrogate ids. A bitmap holds 32,768 ids, so a group has one small row per range of ids it
meets, and coarser groups are unions of bitmaps; the facts are shuffled once, whatever the number of groupings.
Approximate: HyperLogLog sketches, a few KB per group, which can be stored per day and united when they are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def distinct_bitmaps(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """``by, _bucket, _bits``: the values of ``number`` (dense from 1, or any positive whole number) per group."""
    bucket = F.bitmap_bucket_number(number).alias("_bucket")
    return df.where(F.col(number).isNotNull()).groupBy(*by, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))


def merged(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bitmaps of coarser groups."""
    return bitmaps.groupBy(*by, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))


def counted(bitmaps: DataFrame, by: Sequence[str], name: str = "distinct") -> DataFrame:
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("_bits")).alias(name))


def distinct_over(bitmaps: DataFrame, grains: Mapping[str, Sequence[str]], name: str = "distinct") -> DataFrame:
    """Distinct counts on several grains from the bitmaps of the finest: ``grain``, all columns (null above), count."""
    columns = [c for c in bitmaps.columns if c not in ("_bucket", "_bits")]
    kinds = dict(bitmaps.dtypes)
    results = []
    for grain, by in grains.items():
        found = counted(merged(bitmaps, by), by, name)
        results.append(found.select(
            F.lit(grain).alias("grain"), *[F.col(c) if c in by else F.lit(None).cast(kinds[c]).alias(c) for c in columns], name
        ))
    return reduce(DataFrame.unionByName, results)


def sketches(df: DataFrame, by: Sequence[str], value: str, precision: int = 14) -> DataFrame:
    """``by, _sketch``: a sketch of the distinct values per group, with a relative error of about 1 / sqrt(2 ** precision)."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(precision)).alias("_sketch"))


def estimated(stored: DataFrame, by: Sequence[str], name: str = "distinct") -> DataFrame:
    """Estimated distinct values per group, from sketches of finer groups."""
    return stored.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("_sketch")).alias(name))
