"""Structured Streaming hosts of the folds and sinks: throttle, rates, event log; the fold of results with its entities is in streaming.entities, the upserted summary in streaming.upserts.

The functions that hold state are those of operators.state, so a stream that is drained gives the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import state


def event_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; the event clock is a TIMESTAMP, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def throttled(stream: DataFrame, key: str, t: str, row: str, least: int) -> DataFrame:
    """Accepted rows: at least so long after the last accepted one of their key; the state is one number per key."""

    def fold(name: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        last = group.get[0] if group.exists else None
        pdf = pd.concat(list(parts)).sort_values([t, row])
        ok, last = state.throttle(pdf[t].tolist(), least, last)
        group.update((last,))
        yield pdf.loc[ok, [key, row, t]]

    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} long, {row} long, {t} long", "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_rates(stream: DataFrame, t: str, key: str, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Rows per key and tumbling window; rows later than the watermark are discarded."""
    return stream.withWatermark(t, late).groupBy(F.window(t, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def told_once(stream: DataFrame, key: str, clock: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key that arrives, as a notification; later ones of that key within late of it are dropped, and rows that come behind the watermark too, which the progress of the query counts (late_rows)."""
    return stream.withWatermark(clock, late).dropDuplicatesWithinWatermark([key])


def late_rows(query) -> int:
    """How many rows a query has dropped because they came behind its watermark, in the triggers that it still remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """The event log as JSON lines, appended exactly once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def counted(df: DataFrame, name: str | Observation, **kinds: Column) -> DataFrame:
    """df, which reports as metrics of that name, or to that observation, how many rows it had and how many of each kind, in a batch and in each trigger of a stream."""
    return df.observe(name, F.count(F.lit(1)).alias("processed"), *(F.count_if(c).alias(k) for k, c in kinds.items()))
