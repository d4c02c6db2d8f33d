"""Operation logs: the one table of the engine. Columns key, op ('put' or 'delete'), value, ts, seq, category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, op string, value string, ts timestamp, seq bigint, category string"
#: The mapping of the events table, for DuckDB.
SQL = "ops AS (SELECT user_id::VARCHAR AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, props AS value, ts, event_id AS seq, event_type AS category FROM events)"


def from_events(events: DataFrame) -> DataFrame:
    """The test data's events as an operation log: an error deletes its user's key, anything else puts its props."""
    return events.select(
        F.col("user_id").cast("string").alias("key"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.col("props").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("bigint").alias("seq"),
        F.col("event_type").alias("category"),
    )


def read_events(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """The events as a log; with a key only that key's, by a filter on the stored number that Parquet can skip row groups by."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if key is not None:
        number = int(key) if key.lstrip("-").isdigit() and str(int(key)) == key else None
        events = events.where(F.lit(False) if number is None else F.col("user_id") == number)
    return from_events(events)


def append(ops: DataFrame, path: str) -> None:
    """Append operations to a log's folder."""
    ops.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_bucket_states(spark: SparkSession, path: str) -> DataFrame:
    """Token-bucket states of users, from headerless CSV lines user,ignored,tokens_left,last_reset."""
    return spark.read.schema("user string, ignored string, tokens_left int, last_reset bigint").csv(path, header=False).drop("ignored")


def write_bucket_states(states: DataFrame, path: str) -> None:
    """Write token-bucket states (key, tokens_left, last_reset) as the lines that ``read_bucket_states`` takes."""
    states.select("key", F.lit("").alias("ignored"), "tokens_left", "last_reset").write.mode("overwrite").csv(path, header=False)


def write_run(run: DataFrame, path: str, partitions: int = 1) -> None:
    """Write sorted runs, foldered by level and gen, with a Bloom filter of the key in each file."""
    (
        run.repartitionByRange(partitions, "level", "gen", "key")
        .sortWithinPartitions("level", "gen", "key")
        .write.mode("append")
        .option("parquet.bloom.filter.enabled#key", "true")
        .partitionBy("level", "gen")
        .parquet(path)
    )
