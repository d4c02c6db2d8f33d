"""The operation log as a stream: incremental snapshot, rolling sketches, and a stateful token bucket."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import portable_hash
from ..operators import sketches
from ..sources.oplog import from_events


def read_stream(spark: SparkSession, path: str, schema: Any, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """A folder of Parquet files of events as a stream of operations."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return from_events(reader.parquet(path))


def latest_stream(ops: DataFrame) -> DataFrame:
    """Running last state of each key (complete or update mode)."""
    last = F.max_by(F.struct("op", "value", "ts", "seq"), F.struct("ts", "seq"))
    return ops.groupBy("key").agg(last.alias("l")).select("key", "l.*")


def cms_stream(ops: DataFrame, epsilon: float, delta: float) -> DataFrame:
    """Running Count-Min cells of the keys put."""
    width, depth = sketches.cms_size(epsilon, delta)
    cells = F.posexplode(F.array(*(F.pmod(portable_hash(F.col("key"), i), F.lit(width)) for i in range(depth)))).alias("row", "bucket")
    return ops.where("op = 'put'").select(cells).groupBy("row", "bucket").agg(F.count(F.lit(1)).alias("count"))


def windowed_counts(ops: DataFrame, lateness: str, length: str) -> DataFrame:
    """Operations per category and window of event time; what comes later than ``lateness`` is dropped."""
    return ops.withWatermark("ts", lateness).groupBy(F.window("ts", length), "category").agg(F.count(F.lit(1)).alias("n"))


def token_bucket_stream(ops: DataFrame, size: int, interval: int) -> DataFrame:
    """key, seq, admitted: the token bucket with its state kept between batches.

    Inside a batch operations are taken in order of time; one that arrives in a later batch than it should is taken as it comes.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, left = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["second", "micros", "seq"])
        out = []
        for second, seq in zip(rows["second"], rows["seq"], strict=True):
            if opened is None or second - opened > interval:
                opened, left = int(second), size
            out.append((key[0], int(seq), left > 0))
            left = max(0, left - 1)
        state.update((opened, left))
        yield pd.DataFrame(out, columns=["key", "seq", "admitted"])

    timed = ops.select("key", "seq", F.unix_seconds("ts").alias("second"), F.unix_micros("ts").alias("micros"))
    return timed.groupBy("key").applyInPandasWithState(decide, "key string, seq bigint, admitted boolean", "opened bigint, left bigint", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Run a stream until its input is used up; the last state of what it wrote, from Parquet at ``path``.

    Each batch writes a folder of its own number, so one that is run again replaces what it wrote.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data" if mode == "complete" else f"{path}/data/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/data").drop("batch")
