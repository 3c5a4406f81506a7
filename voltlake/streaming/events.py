"""Structured Streaming over detection events: windowed counts and keyed dead time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltlake.runtime import shared_dir


def event_stream(spark: SparkSession, sf_dir: str, table: str = "detection_events", files_per_batch: int = 8) -> DataFrame:
    """The table's files as a stream, each file once."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    return reader.parquet(f"{sf_dir}/{table}*")


def windowed(events: DataFrame, window: str = "1 day", late: str = "60 days") -> DataFrame:
    """Events and amplitude sums per tumbling window and source; each event once within
    the watermark, later ones are dropped by Spark."""
    once = events.withWatermark("detected_at", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("detected_at", window).alias("w"), "source").agg(
        F.count("*").alias("n"), F.sum("amplitude").alias("total"), F.max("amplitude").alias("highest")
    ).select(F.col("w.start").alias("window_start"), "source", "n", "total", "highest")


def run_to_table(result: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """Runs a bounded stream to its end and returns the table of its last state
    (complete) or of all its rows (append). State and table lie in the shared folder."""
    base = f"{shared_dir(spark)}/voltlake-stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(out)


def dead_time_stream(events: DataFrame, channel: str, index: str, min_sep: int) -> DataFrame:
    """Events kept by a dead time after the last kept one of their channel. The state is
    that one index; events must arrive in order of the index, as a detector sends them:
    an event before the last kept one is passed over."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for x in sorted({int(v) for frame in frames for v in frame["x"].dropna()}):
            if last is None or x - last >= min_sep:
                kept.append(x)
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({channel: [key[0]] * len(kept), index: kept})

    types = dict(events.dtypes)
    rows = events.select(F.col(channel).alias("ch"), F.col(index).cast("long").alias("x"))
    return rows.groupBy("ch").applyInPandasWithState(step, f"{channel} {types[channel]}, {index} long", "last long", "append", GroupStateTimeout.NoTimeout)
