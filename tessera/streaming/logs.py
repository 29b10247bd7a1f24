"""Status logs as streams. The windowed aggregate is an extension over event time; the others restate polling loops over append-only logs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, at: str, keys: list[str], value: str, size: str, late: str) -> DataFrame:
    """Counts and sums by tumbling window and keys; rows later than ``late`` behind the newest are dropped by the watermark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Events in a row without a gap, by key."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def latest_status(events: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The newest row of each key so far, by append number."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("r")).select(key, "r.*")


def pass_counter(events: DataFrame, key: str, index: str) -> DataFrame:
    """(key, passes, last_index): a key's index that falls starts a new pass. State for each key: two integers."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        passes, last = state.get if state.exists else (1, None)
        for b in batches:
            for i in b.sort_values("__seq")[index]:
                if last is not None and i < last:
                    passes += 1
                last = int(i)
        state.update((passes, last))
        yield pd.DataFrame({key: [k[0]], "passes": [passes], "last_index": [last]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, passes int, last_index long", "passes int, last long", "update", "NoTimeout")


def stalls(events: DataFrame, key: str, quiet: str) -> DataFrame:
    """(key, events, stalled): a row for each key's new events, and one with stalled where none came for the time ``quiet``, such as "10 minutes". State for each key: a count."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        if state.hasTimedOut:
            state.remove()
        else:
            n += sum(len(b) for b in batches)
            state.update((n,))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame({key: [k[0]], "events": [n], "stalled": [state.hasTimedOut]})

    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)
    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, events long, stalled boolean", "events long", "update", "ProcessingTimeTimeout")


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str | None = None):
    """Drive a stream over what is there into a memory table and return that."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
