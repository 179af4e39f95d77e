"""Progress feeds: what has been reached so far, over a table or over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def reached(events: DataFrame, key: str, order: list[str], step: str, message: str) -> DataFrame:
    """Each event with the highest step so far; an event that repeats the message before it is left out."""
    by_key = Window.partitionBy(key).orderBy(*order)
    so_far = F.max(step).over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    repeated = F.col(message).eqNullSafe(F.lag(message).over(by_key)) & F.lag(message).over(by_key).isNotNull()
    return events.withColumn("reached", so_far).withColumn("_repeated", repeated).where("not _repeated").drop("_repeated")


def percent(step, total, floor: int = 4):
    """A whole percentage of steps, never below ``floor`` before the end."""
    return F.when(step >= total, F.lit(100)).otherwise(F.greatest(F.lit(floor), F.round(step * 100 / total))).cast("int")


def reached_stream(events: DataFrame, key: str, time: str, step: str) -> DataFrame:
    """The highest step of each key over a stream; state is one number a key, late steps change nothing."""
    kind = dict(events.dtypes)[key]

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        high = state.get[0] if state.exists else float("-inf")
        for frame in frames:
            if len(frame):
                high = max(high, float(frame[step].max()))
        state.update((high,))
        yield pd.DataFrame({key: [group[0]], "reached": [high]})

    return events.select(key, time, step).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, reached double", "high double", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, key: str, time: str, late: str = "1 hour", wide: str = "1 day") -> DataFrame:
    """Events of each key and window, with a watermark for late ones; the same over a table and over a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, wide).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("window_start"), key, "events")
