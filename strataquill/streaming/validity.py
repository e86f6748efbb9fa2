"""Validity events as a stream: windowed counts with late data, and the latest state per key."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataquill.session import new_path


def event_stream(spark: SparkSession, path: str, glob: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as a stream, under the schema of what is there now."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path)


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and kind; works on a stream (with a watermark) and on a table alike."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def accepted_transitions(events: DataFrame, key: str, status: str, at: str, ranks: Mapping[str, int]) -> DataFrame:
    """Transitions of a stream that raise the rank of their key, in order of arrival; state is one number per key."""
    kind = events.schema[key].dataType.simpleString()

    def step(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reached = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values(at)
        out = []
        for s, t in zip(rows[status], rows[at], strict=True):
            rank = ranks.get(s, -1)
            if rank > reached:
                reached = rank
                out.append((names[0], s, t))
        state.update((reached,))
        yield pd.DataFrame(out, columns=[key, status, at])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {status} string, {at} timestamp", "reached int", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there and return what it put out, from a table in the shared folder.

    Batches are written by number, so one that is run again after a failure replaces itself; in complete mode the result
    is the last of them, else all.
    """
    spark, path = stream.sparkSession, new_path(stream.sparkSession, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)
