"""Incremental forms of batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tunewright.functions import music
from tunewright.shared import new_path


def stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive; path may be a pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_once(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Drain what the stream has now and return what it wrote. Checkpoint and output lie in the shared folder, so a
    restarted query goes on where it stopped and no batch is written twice."""
    spark = df.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "state")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if each is not None:
        query = writer.foreachBatch(each).start()
    elif mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:  # the last batch holds the whole result
        query = writer.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def first_seen(songs: DataFrame, time: str = "received_at", delay: str = "60 days") -> DataFrame:
    """The first song of each exact fingerprint within the watermark; state older than the delay is dropped."""
    keyed = songs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).withColumn("fp", music.exact_fingerprint(F.col("bpm"), F.col("events")))
    return keyed.dropDuplicatesWithinWatermark(["fp"])


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums per tumbling window and kind, emitted when the watermark has passed the window."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def recency(rows: DataFrame, key: str = "user_id", value: str = "event_type", order: tuple[str, str] = ("ts", "event_id")) -> DataFrame:
    """key, value, run: after every batch, for each key that it brought rows of, its latest value and how many times in a row it has
    had it. The state is one value and one number per key, whatever the length of its history; nulls are equal to each other.

    Rows count in the given order within a batch, and batches in the order in which they come.
    """
    kind = rows.schema[key].dataType.simpleString()

    def step(at: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (None, 0)
        batch = pd.concat(list(parts)).sort_values(list(order))  # one key's rows of one batch
        values = batch[value].astype(object).where(batch[value].notna(), None).tolist()
        for v in values:
            last, run = v, run + 1 if run and v == last else 1
        state.update((last, run))
        yield pd.DataFrame({key: [at[0]], value: [last], "run": [run]})

    return rows.select(key, value, *order).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {value} string, run bigint", "last string, run bigint", "append", GroupStateTimeout.NoTimeout)
