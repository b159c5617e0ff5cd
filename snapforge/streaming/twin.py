"""Streaming twins of the daily batch: idempotent arrival, daily aggregates, status changes and runs of bad days."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "2 days") -> DataFrame:
    """Rows whose keys came before, within the watermark, are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def daily(stream: DataFrame, key: str, value: str, time: str = "ts", late: str | None = "2 days") -> DataFrame:
    """Mean and number by key and day, once the watermark has passed; late: None where the stream has one already."""
    rows = (stream.withWatermark(time, late) if late else stream).groupBy(F.window(time, "1 day"), key).agg(F.avg(value).alias("eur"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.col(key).cast("string").alias("uuid"), F.col("window.start").cast("date").alias("snapshot_date"), "eur", "n")


def changes(stream: DataFrame, key: str, status: str, time: str = "ts") -> DataFrame:
    """(key, before, after, at) whenever a key's status differs from its last one; state: one status a key."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(batches).sort_values(time).itertuples():
            now = getattr(row, status)
            if before is not None and now != before:
                out.append((k[0], before, now, getattr(row, time)))
            before = now
        state.update((before,))
        yield pd.DataFrame(out, columns=[key, "before", "after", "at"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, before string, after string, at timestamp", "status string", "append", GroupStateTimeout.NoTimeout)


def bad_days(stream: DataFrame, key: str, value: str, time: str = "ts", threshold: float = 30.0, n: int = 3) -> DataFrame:
    """(key, at, run) at each row that makes a run of n or more rows beyond the threshold; state: the run's length, one number a key.
    A null ends a run. Rows of a micro-batch are taken in the order of their time."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(batches).sort_values(time).itertuples():
            length = length + 1 if getattr(row, value) > threshold else 0
            if length >= n:
                out.append((k[0], getattr(row, time), length))
        state.update((length,))
        yield pd.DataFrame(out, columns=[key, "at", "run"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at timestamp, run long", "length long", "append", GroupStateTimeout.NoTimeout)


def append_batches(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Each micro-batch is appended without the rows whose keys are there already."""
    from ..sources.io import append

    return stream.writeStream.foreachBatch(lambda df, _: append(df.dropDuplicates(keys), path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
