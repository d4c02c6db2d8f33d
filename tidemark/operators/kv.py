"""The keyed table: last write wins, by (ts, seq); tombstones hide older values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.oplog import SQL

LATEST = f"WITH {SQL}, latest AS (SELECT key, last(struct_pack(op := op, value := value, ts := ts, seq := seq) ORDER BY ts, seq) AS l FROM ops GROUP BY key)"


def latest(ops: DataFrame) -> DataFrame:
    """One row per key: its last operation. A map-side aggregate, so hot keys shuffle one row per task."""
    last = F.max_by(F.struct("op", "value", "ts", "seq"), F.struct("ts", "seq"))
    return ops.groupBy("key").agg(last.alias("l")).select("key", "l.*")


def snapshot(ops: DataFrame) -> DataFrame:
    """Live keys: key, value, ts, seq."""
    return latest(ops).where("op <> 'delete'").drop("op")


def get(ops: DataFrame, key: str) -> DataFrame:
    """One live key. The filter reaches the scan, below the aggregate."""
    return snapshot(ops.where(F.col("key") == key))


def status(op: Column) -> Column:
    return F.when(op.isNull(), "MISSING").when(op == "delete", "DELETED").otherwise("FOUND")


def multi_get(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """For each asked key: key, status (FOUND, DELETED, MISSING), value of found ones."""
    found = latest(ops.join(keys.select("key").distinct(), "key", "left_semi"))
    return keys.join(found, "key", "left").select("key", status(F.col("op")).alias("status"), F.when(F.col("op") == "put", F.col("value")).alias("value"))


def delete_effects(ops: DataFrame) -> DataFrame:
    """Each delete, and whether its key was live: key, seq, effective."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("ts", "seq"))
    return ops.withColumn("before", before).where("op = 'delete'").select("key", "seq", F.coalesce(F.col("before") == "put", F.lit(False)).alias("effective"))


def effective(ops: DataFrame) -> DataFrame:
    """The operations that change something: puts, and deletes of live keys."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("ts", "seq"))
    return ops.withColumn("_before", before).where("op = 'put' or _before = 'put'").drop("_before")


def tombstones(ops: DataFrame) -> DataFrame:
    """Every key with its last state, deleted ones kept: key, tombstone, value, seq."""
    return latest(ops).select("key", (F.col("op") == "delete").alias("tombstone"), F.when(F.col("op") == "put", F.col("value")).alias("value"), "seq")


def ordered_scan(ops: DataFrame) -> DataFrame:
    """``tombstones`` in key order, with the place in it."""
    from .order import numbered

    return numbered(tombstones(ops), [], ["key"], "place").orderBy("key")


def overwrites(ops: DataFrame) -> DataFrame:
    """Per key: puts, and how many of them replaced an earlier put or tombstone of the log."""
    return ops.where("op = 'put'").groupBy("key").agg(F.count(F.lit(1)).alias("puts"), (F.count(F.lit(1)) - 1).alias("overwrites"))


def history(ops: DataFrame) -> DataFrame:
    """Versions of each key with their validity: key, version, op, value, valid_from, valid_to (null: still)."""
    w = Window.partitionBy("key").orderBy("ts", "seq")
    return ops.select("key", F.row_number().over(w).alias("version"), "op", "value", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


ORACLES = {
    "kv_snapshot": LATEST + " SELECT key, l.value AS value, l.ts AS ts, l.seq AS seq FROM latest WHERE l.op <> 'delete'",
    "kv_get": LATEST + " SELECT key, l.value AS value, l.ts AS ts, l.seq AS seq FROM latest WHERE l.op <> 'delete' AND key = '7'",
    "kv_multi_get_status": LATEST + """, asked AS (SELECT c_custkey::VARCHAR AS key FROM customer)
      SELECT a.key, CASE WHEN l.op IS NULL THEN 'MISSING' WHEN l.op = 'delete' THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN l.op = 'put' THEN l.value END AS value
      FROM asked a LEFT JOIN latest USING (key)""",
    "kv_delete_effects": f"WITH {SQL}, o AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY ts, seq) AS before FROM ops) SELECT key, seq, coalesce(before = 'put', false) AS effective FROM o WHERE op = 'delete'",
    "kv_tombstones": LATEST + " SELECT key, l.op = 'delete' AS tombstone, CASE WHEN l.op = 'put' THEN l.value END AS value, l.seq AS seq FROM latest",
    "kv_ordered_scan": LATEST + " SELECT key, l.op = 'delete' AS tombstone, CASE WHEN l.op = 'put' THEN l.value END AS value, l.seq AS seq, row_number() OVER (ORDER BY key) AS place FROM latest",
    "kv_overwrite_count": f"WITH {SQL} SELECT key, count(*) AS puts, count(*) - 1 AS overwrites FROM ops WHERE op = 'put' GROUP BY key",
    "kv_history": f"WITH {SQL} SELECT key, (row_number() OVER w)::INT AS version, op, value, ts AS valid_from, lead(ts) OVER w AS valid_to FROM ops WINDOW w AS (PARTITION BY key ORDER BY ts, seq)",
}
