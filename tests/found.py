"""Rows of a DataFrame in a form that tests can compare."""

from __future__ import annotations

import time
from decimal import Decimal


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    return round(value, 6) if isinstance(value, float) else value


def rows(df, *columns):
    """Sorted rows of the named columns, with decimals as floats and nulls first."""
    picked = df.select(*columns) if columns else df
    found = [tuple(plain(v) for v in row) for row in picked.collect()]
    return sorted(found, key=lambda row: [(v is not None, v) for v in row])


def shuffled(spark) -> dict[str, int]:
    """Names and bytes of the shuffle files that lie on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = {}
    while files.hasNext():
        file = files.next()
        if file.getName().startswith("shuffle_"):
            found[file.getName()] = file.length()
    return found


def left_behind(spark, before: dict[str, int], most: int, seconds: int = 10) -> int:
    """Bytes of the shuffle files that came since ``before``; what is being deleted gets some seconds to go."""
    end = time.time() + seconds
    while (left := sum(n for name, n in shuffled(spark).items() if name not in before)) > most and time.time() < end:
        time.sleep(0.2)
    return left
