"""One write buffer, its flushes to sorted runs, and the cascade of runs over levels.

A buffer is sequential: where it is flushed depends on all that came before. But what a stretch of the log
does to it follows from little: the stretch's first distinct keys tell where the first flush
falls, whatever the buffer held, and from there on the stretch goes its own way. So stretches are read side by side, their short
summaries are folded in order, and each stretch is read once more with what it begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..config import Config
from ..functions.scalar import value_crc
from ..sources.oplog import SQL
from . import kv
from .order import in_ranges


class Stretch:
    """Consecutive operations: where a buffer that is empty before each of them would be flushed."""

    def __init__(self, keys: list[str], puts: list[bool], limit: int):
        self.keys, self.limit, self.n = keys, limit, len(keys)
        self.put = np.full(self.n + 1, self.n, np.int64)  # the next put, from each place on
        for i in range(self.n - 1, -1, -1):
            self.put[i] = i if puts[i] else self.put[i + 1]
        self.next = np.full(self.n + 1, self.n, np.int64)
        held: dict[str, int] = {}
        end = 0
        for i in range(self.n):
            while end < self.n and len(held) < limit:
                held[keys[end]] = held.get(keys[end], 0) + 1
                end += 1
            if len(held) < limit:
                break
            self.next[i] = self.put[end - 1]
            held[keys[i]] -= 1
            if not held[keys[i]]:
                del held[keys[i]]

    def first_keys(self, start: int = 0) -> list[tuple[str, int]]:
        """The first ``limit`` distinct keys from a place on, and where they stand."""
        found: dict[str, int] = {}
        for i in range(start, self.n):
            if self.keys[i] not in found:
                found[self.keys[i]] = i
                if len(found) == self.limit:
                    break
        return list(found.items())

    def flushes(self, first: int) -> list[int]:
        """All flushes, if the first is at ``first``."""
        out = []
        while first < self.n:
            out.append(first)
            first = int(self.next[first + 1])
        return out

    def summary(self) -> dict:
        head = [(k, int(self.put[i])) for k, i in self.first_keys()]
        firsts = sorted({int(self.put[0]), *(p for _, p in head)} - {self.n})
        ways = []
        for f in firsts:
            found = self.flushes(f)
            ways.append({"first": f, "flushes": len(found), "held": [k for k, _ in self.first_keys(found[-1] + 1)]})
        return {"rows": self.n, "put": int(self.put[0]), "keys": [k for k, _ in head], "puts": [p for _, p in head], "ways": ways}


def first_flush(held: list[str], keys: list[str], puts: list[int], put: int, limit: int) -> int | None:
    """Where a buffer that holds some keys is flushed first, from a stretch's first distinct keys and the next put after each."""
    if len(held) >= limit:
        return put
    known, size = set(held), len(held)
    for k, p in zip(keys, puts, strict=True):
        if k not in known:
            size += 1
            if size >= limit:
                return p
    return None


SUMMARY = "chunk int, rows bigint, put bigint, keys array<string>, puts array<bigint>, ways array<struct<first: bigint, flushes: bigint, held: array<string>>>"


def generations(ops: DataFrame, config: Config) -> DataFrame:
    """The operations that take effect, with gen (the flush they go out with, from 1) and closes (the put that causes it).

    A put that finds ``flush_keys`` distinct keys in the buffer, its own included, flushes it; deletes add keys and never flush.
    """
    limit = config.flush_keys
    placed = in_ranges(kv.effective(ops).select("key", "op", "value", "ts", "seq"), ["ts", "seq"], "flush-log")
    n = storage.tasks(ops.sparkSession)

    def read(frame: pd.DataFrame) -> Stretch:
        return Stretch(frame["key"].tolist(), (frame["op"] == "put").tolist(), limit)

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames of one chunk each."""
        held: list[pd.DataFrame] = []
        for frame in frames:
            for number, part in frame.groupby("_range", sort=False):
                if held and held[0]["_range"].iat[0] != number:
                    yield pd.concat(held, ignore_index=True)
                    held = []
                held.append(part)
        if held:
            yield pd.concat(held, ignore_index=True)

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames):
            yield pd.DataFrame([{"chunk": int(frame["_range"].iat[0]), **read(frame).summary()}])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen, held = 1, []
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                out.append((r.chunk, gen, list(held)))
                first = first_flush(held, list(r.keys), list(r.puts), r.put, limit)
                way = next((w for w in r.ways if w["first"] == first), None)
                if way is None:
                    held = list(dict.fromkeys([*held, *r.keys]))[:limit]
                else:
                    gen, held = gen + int(way["flushes"]), list(way["held"])
            yield pd.DataFrame(out, columns=["_range", "begins", "held"])

    dealt = placed.repartitionById(n, F.col("_range"))
    summaries = dealt.sortWithinPartitions("_range", "_at").select("_range", "key", "op").mapInPandas(summarise, SUMMARY)
    # One short row per range of the log.
    starts = summaries.repartition(1).sortWithinPartitions("chunk").mapInPandas(fold, "_range int, begins bigint, held array<string>")

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames):
            gen, held = int(frame["begins"].iat[0]), list(frame["held"].iat[0])
            frame = frame.iloc[1:].drop(columns=["_range", "begins", "held"])
            stretch = read(frame)
            head = stretch.first_keys()
            first = first_flush(held, [k for k, _ in head], [int(stretch.put[i]) for _, i in head], int(stretch.put[0]), limit)
            at = np.array(stretch.flushes(stretch.n if first is None else first), np.int64)
            closes = np.zeros(stretch.n, bool)
            closes[at] = True
            yield frame.assign(gen=gen + np.searchsorted(at, np.arange(stretch.n), side="left"), closes=closes)

    rows = placed.withColumn("begins", F.lit(None).cast("bigint")).withColumn("held", F.lit(None).cast("array<string>"))
    both = rows.unionByName(starts.withColumn("_at", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    names = ["_range", "begins", "held", "key", "op", "value", "ts", "seq"]
    played = both.repartitionById(n, F.col("_range")).sortWithinPartitions("_range", "_at").select(*names)
    return played.mapInPandas(assign, "key string, op string, value string, ts timestamp, seq bigint, gen bigint, closes boolean")


def flush_plan(ops: DataFrame, config: Config) -> DataFrame:
    """The flushes that the log causes: gen, n_ops, n_keys, first_seq, last_seq, flushed; the last gen may be unflushed."""
    at = F.struct("ts", "seq")
    return generations(ops, config).groupBy("gen").agg(
        F.count(F.lit(1)).alias("n_ops"), F.count_distinct("key").alias("n_keys"), F.min_by("seq", at).alias("first_seq"), F.max_by("seq", at).alias("last_seq"), F.max("closes").alias("flushed")
    )


def buffers(flushed: DataFrame) -> DataFrame:
    """What each flush writes, and what the buffer still holds (level 0): level, gen, key, value, tombstone, ts, crc.

    A key's last operation counts. A delete keeps the value that the buffer held, if any.
    """
    at = F.struct("ts", "seq")
    done = flushed.where("closes").select("gen").withColumn("level", F.lit(1))
    last = flushed.groupBy("gen", "key").agg(F.max_by(F.struct("op", "value", "ts"), at).alias("l"), F.max_by(F.when(F.col("op") == "put", F.struct("value")), F.when(F.col("op") == "put", at)).alias("p"))
    value = F.when((F.col("l.op") == "delete") & F.col("p").isNotNull(), F.col("p.value")).otherwise(F.col("l.value"))
    rows = last.join(done, "gen", "left").select(F.coalesce("level", F.lit(0)).alias("level"), "gen", "key", value.alias("value"), (F.col("l.op") == "delete").alias("tombstone"), F.col("l.ts").alias("ts"))
    return rows.withColumn("crc", value_crc(F.col("value")))


def cascade(run: DataFrame, config: Config, annihilate: bool = False) -> DataFrame:
    """Runs of level 1 (gen 1, 2, ...) merged level by level: whenever ``lsm_merge_threshold`` runs of a level are
    complete they become the next run of the level below, down to ``lsm_max_lvl``, whose runs pile up.

    The newest record of a key stays. A tombstone stays too, until its run is the oldest there is: below it nothing is left to
    hide. Merging is associative then, so every record goes straight to its last run, by one aggregate. With ``annihilate`` a merge drops a
    tombstone together with the record it hides, as a store does that may bring a deeper record back.
    """
    fan, deepest = config.lsm_merge_threshold, config.lsm_max_lvl
    record = ["value", "tombstone", "ts", "crc"]
    total = run.agg(F.coalesce(F.max("gen"), F.lit(0)).alias("total"))  # one row
    rows = run.select(F.lit(1).alias("level"), F.col("gen").cast("bigint").alias("gen"), "key", *record).crossJoin(F.broadcast(total))
    if not annihilate:
        where = F.struct(F.lit(deepest).alias("level"), (F.floor((F.col("gen") - 1) / fan ** (deepest - 1)) + 1).alias("gen"))
        for depth in range(deepest - 1, 0, -1):
            # What makes no whole run of the level below stays here, numbered from 1.
            whole = F.floor(F.col("total") / fan**depth) * fan**depth
            here = F.floor((F.col("gen") - whole - 1) / fan ** (depth - 1)) + 1
            where = F.when(F.col("gen") <= whole, where).otherwise(F.struct(F.lit(depth).alias("level"), here.alias("gen")))
        placed = rows.select(where.alias("w"), "key", F.col("gen").alias("flush"), F.struct(*record).alias("r"))
        merged = placed.groupBy(F.col("w.level").alias("level"), F.col("w.gen").cast("bigint").alias("gen"), "key").agg(F.max_by("r", "flush").alias("r")).select("level", "gen", "key", "r.*")
        return merged.where(~(F.col("tombstone") & (F.col("level") == deepest) & (F.col("gen") == 1)))
    for level in range(1, deepest):
        whole = F.floor(F.floor(F.col("total") / fan ** (level - 1)) / fan) * fan
        here, done = F.col("level") == level, F.col("gen") <= whole
        up = rows.where(here & done).groupBy(F.floor((F.col("gen") - 1) / fan).cast("bigint").alias("g"), "key", "total").agg(F.max_by(F.struct(*record), "gen").alias("r"), F.count(F.lit(1)).alias("n"))
        up = up.where(~((F.col("n") > 1) & F.col("r.tombstone"))).select(F.lit(level + 1).alias("level"), (F.col("g") + 1).alias("gen"), "key", "r.*", "total")
        rest = rows.where(~here | ~done).withColumn("gen", F.when(here, F.col("gen") - whole).otherwise(F.col("gen")).cast("bigint"))
        rows = rest.unionByName(up)
    return rows.select("level", "gen", "key", *record)


def lookup(buffer: DataFrame, run: DataFrame, keys: DataFrame) -> DataFrame:
    """key, status, value, level, gen: each asked key in the buffer, then level by level, the newest run of a level first."""
    layers = buffer.select("key", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("gen"), "value", "tombstone").unionByName(run.select("key", "level", "gen", "value", "tombstone"))
    wanted = layers.join(keys.select("key").distinct(), "key", "left_semi")
    found = wanted.groupBy("key").agg(F.min_by(F.struct("level", "gen", "value", "tombstone"), F.struct("level", -F.col("gen"))).alias("f"))
    state = F.when(F.col("f").isNull(), "MISSING").when(F.col("f.tombstone"), "DELETED").otherwise("FOUND")
    return keys.join(found, "key", "left").select("key", state.alias("status"), F.when(~F.col("f.tombstone"), F.col("f.value")).alias("value"), "f.level", "f.gen")


_GENS = f"""WITH RECURSIVE {SQL},
  o AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY ts, seq) AS before FROM ops),
  i AS (SELECT key, op, value, ts, seq, row_number() OVER (ORDER BY ts, seq) AS i FROM o WHERE op = 'put' OR before = 'put'),
  f AS (SELECT 0::BIGINT AS i, 1::BIGINT AS gen, []::VARCHAR[] AS keys, false AS closes
        UNION ALL
        SELECT i, gen, CASE WHEN closes THEN []::VARCHAR[] ELSE keys END, closes FROM (
          SELECT *, op = 'put' AND len(keys) >= 7 AS closes FROM (
            SELECT i.i, f.gen + f.closes::INT AS gen, i.op, CASE WHEN list_contains(f.keys, i.key) THEN f.keys ELSE list_append(f.keys, i.key) END AS keys FROM f JOIN i ON i.i = f.i + 1))),
  g AS (SELECT i.*, f.gen, f.closes FROM f JOIN i USING (i))"""
_BUFFERS = _GENS + """,
  d AS (SELECT gen FROM g WHERE closes),
  l AS (SELECT gen, key, arg_max(struct_pack(op := op, value := value, ts := ts), i) AS l, arg_max(struct_pack(value := value), i) FILTER (op = 'put') AS p FROM g GROUP BY gen, key),
  b AS (SELECT CASE WHEN gen IN (SELECT gen FROM d) THEN 1 ELSE 0 END AS level, gen, key, CASE WHEN l.op = 'delete' AND p IS NOT NULL THEN p.value ELSE l.value END AS value, l.op = 'delete' AS tombstone, l.ts AS ts FROM l)"""
_LEVELS = _BUFFERS + """,
  t AS (SELECT max(gen) AS t FROM b WHERE level = 1),
  w AS (SELECT b.* EXCLUDE (level, gen), gen AS flush, CASE WHEN gen <= t // 4 * 4 THEN 3 WHEN gen <= t // 2 * 2 THEN 2 ELSE 1 END AS level,
               CASE WHEN gen <= t // 4 * 4 THEN (gen - 1) // 4 + 1 WHEN gen <= t // 2 * 2 THEN (gen - t // 4 * 4 - 1) // 2 + 1 ELSE gen - t // 2 * 2 END AS gen FROM b, t WHERE b.level = 1),
  m AS (SELECT level, gen, key, arg_max(struct_pack(value := value, tombstone := tombstone, ts := ts), flush) AS r FROM w GROUP BY level, gen, key),
  c AS (SELECT level, gen, key, r.value AS value, r.tombstone AS tombstone, r.ts AS ts FROM m WHERE NOT (r.tombstone AND level = 3 AND gen = 1))"""

ORACLES = {
    "flush_plan": _GENS + " SELECT gen, count(*) AS n_ops, count(DISTINCT key) AS n_keys, arg_min(seq, i) AS first_seq, arg_max(seq, i) AS last_seq, bool_or(closes) AS flushed FROM g GROUP BY gen",
    "lsm_flush_runs": _BUFFERS + " SELECT level, gen, key, value, tombstone, ts FROM b",
    "lsm_cascade": _LEVELS + " SELECT level, gen, key, value, tombstone, ts FROM c",
    "lsm_levels_get": _LEVELS + """,
      a AS (SELECT key, 0 AS level, 0::BIGINT AS gen, value, tombstone FROM b WHERE level = 0 UNION ALL SELECT key, level, gen, value, tombstone FROM c),
      n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, gen DESC) AS n FROM a)
      SELECT k.key, CASE WHEN n.key IS NULL THEN 'MISSING' WHEN tombstone THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN NOT tombstone THEN value END AS value, level, gen
      FROM (SELECT c_custkey::VARCHAR AS key FROM customer) k LEFT JOIN (SELECT * FROM n WHERE n = 1) n USING (key)""",
}
