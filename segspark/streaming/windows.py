"""Windows over event streams. The same functions take batch DataFrames; on streams, watermarks bound the state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str, by: list[str], value: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts and sums in fixed windows."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.unix_timestamp("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, width: str, step: str, by: list[str], value: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    rows = events.withWatermark(time, late).groupBy(F.window(time, width, step), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return rows.select(F.unix_timestamp("window.start").alias("start"), *by, "n", "mean")


def sessions(events: DataFrame, gap: str, by: list[str], late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Runs of events with less than ``gap`` between neighbours: islands in time."""
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return rows.select(F.unix_timestamp("session_window.start").alias("start"), F.unix_timestamp("session_window.end").alias("end"), *by, "n")


def changed_enough(events: DataFrame, by: str, share: float, value: str = "value", time: str = "ts") -> DataFrame:
    """Per key, in time within each batch, only the events whose value differs from the last one kept by more than ``share`` of it. The state
    is one number a key."""
    kind = events.schema[by].dataType.simpleString()

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(time)
        kept = []
        for t, x in zip(rows[time], rows[value]):
            if last is None or abs(x - last) > share * abs(last):
                kept.append((key[0], t, x))
                last = float(x)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=[by, time, value])

    return events.select(by, time, value).groupBy(by).applyInPandasWithState(keep, f"{by} {kind}, {time} timestamp, {value} double", "last double", "append", GroupStateTimeout.NoTimeout)
