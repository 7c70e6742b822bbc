"""The latest record per key of a stream.

The state of a key is its latest record so far. A later record replaces it and is passed on; an earlier one changes
nothing. When the watermark has gone ``idle`` beyond the latest record, the state is dropped: what could still arrive
for it by then is later, and is a new latest record for whoever keeps the table (see ``sinks.upsert``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fractions of a second that the packed records keep.
FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _sortable(df: DataFrame, name: str) -> Column:
    """Text that sorts as the column does: numbers moved above zero and padded, other types as they are written."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.lpad((F.col(name).cast("decimal(38,0)") + F.lit(str(1 << 63)).cast("decimal(38,0)")).cast("string"), 20, "0")
    if kind not in ("string", "date"):
        raise TypeError(f"cannot break ties by {name}, a {kind}")
    return F.col(name).cast("string")


def latest_stream(
    events: DataFrame, keys: Sequence[str], ts: str, tie_break: Sequence[str], lateness: str = "1 day",
    idle: timedelta = timedelta(days=7),
) -> DataFrame:
    """Each key's record whenever a later one has replaced it, for output mode ``update``.

    Later is a larger ``ts``, then larger ``tie_break`` (whole numbers, texts or dates; they must tell rows apart). A null
    ``ts`` loses against any, as in ``latest_per_key``. Records later than ``lateness`` behind the newest are dropped.
    """
    schema, names = events.schema, events.columns
    ties = F.transform(F.array(*[_sortable(events, c) for c in tie_break]), lambda x: F.coalesce(F.concat(F.lit("1"), x), F.lit("0")))
    packed = events.select(
        *keys, F.col(ts).cast("timestamp").alias("_at"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_micros"),
        F.array_join(ties, "\0").alias("_ties"), F.to_json(F.struct(*names), FORMATS).alias("_record"),
    ).withWatermark("_at", lateness)
    key_fields = ", ".join(f"{k} {dict(events.dtypes)[k]}" for k in keys)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = found = tuple(state.get) if state.exists else None
        for part in parts:
            for micros, ties, record in zip(part["_micros"], part["_ties"], part["_record"]):
                at = -(1 << 63) if pd.isna(micros) else int(micros)
                if best is None or (at, ties) > best[:2]:
                    best = (at, ties, record)
        if best is None or best == found:
            return
        state.update(best)
        until = max(best[0] // 1000, 0) + int(idle.total_seconds() * 1000)
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "_record": [best[2]]})

    latest = packed.groupBy(*keys).applyInPandasWithState(
        step, f"{key_fields}, _record string", "at bigint, ties string, record string", "update", GroupStateTimeout.EventTimeTimeout
    )
    return latest.select(F.from_json("_record", schema, FORMATS).alias("r")).select("r.*")
