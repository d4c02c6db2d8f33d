"""Admission by token buckets, and hits of a least-recently-used cache, both exact and spread over tasks."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.oplog import SQL
from . import kv
from .order import day


#: Tokens that a verb costs: a delete and a put under a name of its own each ask twice.
COSTS = {"put": 1, "get": 1, "delete": 2, "put_special": 2}


def cost_of(op: Column) -> Column:
    cost = F.lit(1)
    for verb, tokens in COSTS.items():
        cost = F.when(op == verb, tokens).otherwise(cost)
    return cost


def _used(ops: DataFrame, size: int, interval: int, cost: Column | None, states: DataFrame | None) -> DataFrame:
    """key, seq, ts, cost and the window of each operation: opened, capacity."""
    timed = ops.select("key", "seq", "ts", F.unix_seconds("ts").alias("second"), (F.lit(1) if cost is None else cost).cast("bigint").alias("cost"))
    seconds = timed.select("key", "second").distinct().withColumn("left", F.lit(None).cast("bigint"))
    if states is not None:
        seconds = seconds.unionByName(states.select("key", F.col("last_reset").cast("bigint").alias("second"), F.col("tokens_left").cast("bigint").alias("left")))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, opened, capacity = None, 0, size
        for frame in frames:
            out = []
            for k, s, left in zip(frame["key"], frame["second"], frame["left"], strict=True):
                if not pd.isna(left):
                    key, opened, capacity = k, s, int(left)
                    continue
                if k != key or s - opened > interval:
                    key, opened, capacity = k, s, size
                out.append((k, s, opened, capacity))
            yield pd.DataFrame(out, columns=["key", "second", "opened", "capacity"])

    n = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = seconds.repartition(n, "key").sortWithinPartitions("key", F.col("left").isNull(), "second")
    windows = dealt.mapInPandas(walk, "key string, second bigint, opened bigint, capacity bigint")
    return timed.join(windows, ["key", "second"])


def token_bucket(ops: DataFrame, size: int, interval: int, cost: Column | None = None, states: DataFrame | None = None) -> DataFrame:
    """key, seq, admitted: a window opens at a key's first operation more than ``interval`` seconds after the last one opened; ``size`` tokens pass in it.

    An operation takes ``cost`` tokens (1), one after the other, and passes if it gets all; one that doesn't has used up what was left. ``states`` (key, tokens_left, last_reset)
    are buckets to go on with: their last window holds what is left in them.

    Where windows open depends only on the seconds at which a key is seen: those are reduced
    first, map-side, and walked in order. Tokens are then added up inside a window, so a hot key spreads over its windows.
    """
    so_far = F.sum("cost").over(Window.partitionBy("key", "opened").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return _used(ops, size, interval, cost, states).select("key", "seq", (so_far <= F.col("capacity")).alias("admitted"))


def bucket_states(ops: DataFrame, size: int, interval: int, cost: Column | None = None, states: DataFrame | None = None) -> DataFrame:
    """key, tokens_left, last_reset: each key's bucket after the log; a key of ``states`` that isn't in the log keeps its state."""
    spent = _used(ops, size, interval, cost, states).groupBy("key", "opened", "capacity").agg(F.sum("cost").alias("spent"))
    last = spent.groupBy("key").agg(F.max_by(F.struct("opened", "capacity", "spent"), "opened").alias("l"))
    now = last.select("key", F.greatest(F.lit(0), F.col("l.capacity") - F.col("l.spent")).cast("bigint").alias("tokens_left"), F.col("l.opened").alias("last_reset"))
    if states is None:
        return now
    return now.unionByName(states.join(now, "key", "left_anti").select("key", F.col("tokens_left").cast("bigint").alias("tokens_left"), F.col("last_reset").cast("bigint").alias("last_reset")))


def outcomes(ops: DataFrame, size: int, interval: int) -> DataFrame:
    """key, seq, op, outcome: THROTTLED, else STORED of a put, and DELETED or MISSING of a delete. What is throttled changes nothing."""
    asked = ops.join(token_bucket(ops, size, interval, cost_of(F.col("op"))), ["key", "seq"])
    effects = kv.delete_effects(asked.where("admitted")).select("key", "seq", "effective")
    found = F.when(~F.col("admitted"), "THROTTLED").when(F.col("op") == "put", "STORED").when(F.col("effective"), "DELETED").otherwise("MISSING")
    return asked.join(effects, ["key", "seq"], "left").select("key", "seq", "op", found.alias("outcome"))


def admitted_per_key(ops: DataFrame, size: int, interval: int) -> DataFrame:
    return token_bucket(ops, size, interval).groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("admitted"), 1)).alias("admitted"))


def lru_hits(trace: DataFrame, capacity: int) -> DataFrame:
    """key, accesses, hits of a cache of the ``capacity`` most recently used keys over one trace (key, ts, seq).

    Cut by day: what the cache holds when a day starts are the last ``capacity`` distinct keys before it, found
    from each day's own last ones; then days run side by side.
    """
    d = trace.select("key", "ts", "seq", day().alias("day"))
    last = d.groupBy("day", "key").agg(F.max(F.struct("ts", "seq")).alias("at"))
    recent = last.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("at")))).where(F.col("r") <= capacity)
    ends = recent.groupBy("day").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("keys"))

    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict[str, None] = OrderedDict()
        for frame in frames:
            before = []
            for keys in frame["keys"]:
                before.append(list(held))
                for k in keys:
                    held.pop(k, None)
                    held[k] = None
                while len(held) > capacity:
                    held.popitem(last=False)
            yield pd.DataFrame({"day": frame["day"], "seq": -1, "key": None, "held": before})

    # One short row per day.
    starts = ends.repartition(1).sortWithinPartitions("day").mapInPandas(carry, "day timestamp, seq bigint, key string, held array<string>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: OrderedDict[str, None] = OrderedDict()
        for frame in frames:
            counts: dict[str, list[int]] = {}
            for seq, key, start in zip(frame["seq"], frame["key"], frame["held"], strict=True):
                if seq == -1:
                    held = OrderedDict.fromkeys(start)
                    continue
                c = counts.setdefault(key, [0, 0])
                c[0] += 1
                if key in held:
                    c[1] += 1
                    held.move_to_end(key)
                else:
                    held[key] = None
                    if len(held) > capacity:
                        held.popitem(last=False)
            yield pd.DataFrame([(k, a, h) for k, (a, h) in counts.items()], columns=["key", "accesses", "hits"])

    n = int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = d.select("day", "ts", "seq", "key", F.lit(None).cast("array<string>").alias("held")).unionByName(starts.select("day", F.lit(None).cast("timestamp").alias("ts"), "seq", "key", "held"))
    played = rows.repartition(n, "day").sortWithinPartitions("day", F.asc_nulls_first("ts"), "seq").select("seq", "key", "held").mapInPandas(run, "key string, accesses bigint, hits bigint")
    return played.groupBy("key").agg(F.sum("accesses").alias("accesses"), F.sum("hits").alias("hits"))


_WALK = f"""WITH RECURSIVE {SQL}, s AS (SELECT DISTINCT key, epoch(date_trunc('second', ts))::BIGINT AS second FROM ops),
  n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY second) AS i FROM s),
  w AS (SELECT key, i, second, second AS opened FROM n WHERE i = 1
        UNION ALL SELECT n.key, n.i, n.second, CASE WHEN n.second - w.opened > 86400 THEN n.second ELSE w.opened END FROM w JOIN n ON n.key = w.key AND n.i = w.i + 1),
  a AS (SELECT o.key, o.seq, row_number() OVER (PARTITION BY o.key, w.opened ORDER BY o.ts, o.seq) <= 3 AS admitted
        FROM ops o JOIN w ON w.key = o.key AND w.second = epoch(date_trunc('second', o.ts))::BIGINT)"""

_COSTS = _WALK.split("  a AS (")[0] + """  c AS (SELECT o.key, o.seq, o.ts, o.op, w.opened, sum(CASE WHEN o.op = 'delete' THEN 2 ELSE 1 END) OVER (PARTITION BY o.key, w.opened ORDER BY o.ts, o.seq) AS spent
        FROM ops o JOIN w ON w.key = o.key AND w.second = epoch(date_trunc('second', o.ts))::BIGINT)"""

ORACLES = {
    "token_bucket": _WALK + " SELECT key, seq, admitted FROM a",
    "token_bucket_totals": _WALK + " SELECT key, count(*) AS requests, count(*) FILTER (admitted) AS admitted FROM a GROUP BY key",
    "token_bucket_costs": _COSTS + " SELECT key, seq, spent <= 3 AS admitted FROM c",
    "token_bucket_states": _COSTS + ", l AS (SELECT key, opened, max(spent) AS spent FROM c GROUP BY key, opened) SELECT key, greatest(0, 3 - arg_max(spent, opened))::BIGINT AS tokens_left, max(opened) AS last_reset FROM l GROUP BY key",
    "token_bucket_resumed": _COSTS + " SELECT key, seq, spent <= 3 AS admitted FROM c WHERE ts >= date_trunc('month', (SELECT max(ts) FROM ops))",
    "kv_outcomes": _COSTS + """, b AS (SELECT key, seq, lag(op) OVER (PARTITION BY key ORDER BY ts, seq) AS before FROM c WHERE spent <= 3)
      SELECT c.key, c.seq, c.op, CASE WHEN spent > 3 THEN 'THROTTLED' WHEN op = 'put' THEN 'STORED' WHEN before = 'put' THEN 'DELETED' ELSE 'MISSING' END AS outcome FROM c LEFT JOIN b USING (key, seq)""",
    "lru_hits": f"""WITH {SQL}, t AS (SELECT key, row_number() OVER (ORDER BY ts, seq) AS i FROM ops), p AS (SELECT *, lag(i) OVER (PARTITION BY key ORDER BY i) AS before FROM t),
      d AS (SELECT p.key, p.i, p.before, count(DISTINCT t.key) AS apart FROM p LEFT JOIN t ON t.i > p.before AND t.i < p.i GROUP BY ALL)
      SELECT key, count(*) AS accesses, count(*) FILTER (before IS NOT NULL AND apart < 5) AS hits FROM d GROUP BY key""",
}
