"""Change rows that arrive over time, in Structured Streaming.

Rows of a stream must not go back in time. ``monotonic`` keeps the last time of each stream as state, across
micro-batches, and tells rows that break the rule from the others; ``slice_changes`` keeps the last value of each slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.logic import slice_bits
from ..sources.store import KEYS, META, is_store, meta_row, store_scale, write_changes


def _late(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    before = rows["t"].cummax().shift(fill_value=rows["t"].iloc[0] if last is None else last)
    if last is not None:
        before = before.clip(lower=last)
    rows["late"] = rows["t"] < before
    state.update((int(max(rows["t"].max(), last if last is not None else rows["t"].max())),))
    yield rows


def monotonic(changes: DataFrame) -> DataFrame:
    """changes with late: whether the row's time is before an earlier row's of its stream (in order of seq)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema)
    return changes.groupBy("stream_id").applyInPandasWithState(_late, f"{fields}, late boolean", "last bigint", "append", GroupStateTimeout.NoTimeout)


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["t", "seq"], kind="stable")
    before = rows["bits"].shift()
    before.iloc[0] = last
    state.update((rows["bits"].iloc[-1],))
    yield rows[rows["bits"] != before]


def slice_changes(changes: DataFrame, offset: int, width: int) -> DataFrame:
    """stream_id, t, seq, bits: changes of one bit slice of every logic stream."""
    rows = changes.filter("bits IS NOT NULL").select("stream_id", "t", "seq", slice_bits("bits", offset, width).alias("bits"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("stream_id").applyInPandasWithState(_changed, fields, "last string", "append", GroupStateTimeout.NoTimeout)


def append_to_store(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what there is to the changes folder of a store (or to any folder). Each batch is a folder of its own, named
    after the checkpoint and the batch, sorted by stream and time; one that is written again replaces itself, and so
    does its row in the store's ``meta``, which is written after it."""
    run = f"{zlib.crc32(checkpoint.encode()):08x}"
    store = path.rstrip("/").removesuffix("/changes") if path.rstrip("/").endswith("/changes") else None

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
        seen = write_changes(dealt, f"{path}/batch={run}-{number}", "overwrite")
        if store is not None and is_store(spark, store):
            row = meta_row(store_scale(spark, store), "changes", seen)
            spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").parquet(f"{store}/meta/batch={run}-{number}")

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
