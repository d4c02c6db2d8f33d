"""Log-structured layout as queries: segments, runs, offsets, compaction, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions.scalar import record_bytes, value_crc
from ..sources.oplog import SQL
from . import kv
from .order import numbered, running

def wal_segments(ops: DataFrame, size: int) -> DataFrame:
    """The log cut into segments of ``size`` records in arrival order: seq, segment, key, op."""
    n = numbered(ops, [], ["ts", "seq"], "n")
    return n.select("seq", (F.floor((F.col("n") - 1) / size) + 1).cast("bigint").alias("segment"), "key", "op")


def wal_replay(ops: DataFrame, size: int) -> DataFrame:
    """State after replaying segments in order: the last record of each key over (segment, place)."""
    n = numbered(ops, [], ["ts", "seq"], "n")
    return n.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "n").alias("l"), (F.floor((F.max("n") - 1) / size) + 1).cast("bigint").alias("segment")).select("key", (F.col("l.op") == "delete").alias("tombstone"), F.when(F.col("l.op") == "put", F.col("l.value")).alias("value"), F.col("l.seq").alias("seq"), "segment")


def wal_records(ops: DataFrame) -> DataFrame:
    """Framed records: seq, key, crc of the value, sizes, bytes."""
    return ops.select("seq", "key", value_crc(F.col("value")).alias("crc"), F.octet_length("key").alias("key_size"), F.coalesce(F.octet_length("value"), F.lit(0)).alias("value_size"), record_bytes(F.col("key"), F.col("value")).alias("bytes"))


def split_corrupt(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound, corrupt) records with columns value and crc: a bad record is set aside, not fatal."""
    ok = F.coalesce(value_crc(F.col("value")) == F.col("crc"), F.lit(False))
    return records.where(ok), records.where(~ok)


def day_number(ts: str) -> F.Column:
    return F.unix_date(F.to_date(ts)).cast("int")


def runs(ops: DataFrame) -> DataFrame:
    """Sorted runs, one generation per day of the log (days since 1970) at level 1: level, gen, key, value, tombstone, ts, crc."""
    gen = day_number("ts")
    last = F.max_by(F.struct("op", "value", "ts", "seq"), F.struct("ts", "seq"))
    by_day = ops.groupBy(gen.alias("gen"), "key").agg(last.alias("l"))
    return by_day.select(F.lit(1).alias("level"), "gen", "key", F.col("l.value").alias("value"), (F.col("l.op") == "delete").alias("tombstone"), F.col("l.ts").alias("ts"), value_crc(F.col("l.value")).alias("crc"))


def run_index(run: DataFrame) -> DataFrame:
    """Byte offsets of each record in its run's data and index: level, gen, key, data_offset, index_offset."""
    r = running(run, ["level", "gen"], ["key"], {"data_offset": record_bytes(F.col("key"), F.col("value")), "index_offset": F.lit(16) + F.octet_length("key")})
    return r.select("level", "gen", "key", "data_offset", "index_offset")


def run_summary(run: DataFrame) -> DataFrame:
    """Bounds of each run: level, gen, first_key, last_key, n_keys, n_tombstones."""
    return run.groupBy("level", "gen").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("n_keys"), F.count(F.when(F.col("tombstone"), 1)).alias("n_tombstones"))


def newest_generation(run: DataFrame) -> DataFrame:
    return run.groupBy("level").agg(F.max("gen").alias("newest"))


def manifest(run: DataFrame) -> DataFrame:
    """The component files of each run: level, gen, component, path."""
    parts = ["Data", "Index", "Summary", "Filter", "Metadata", "TOC"]
    path = F.format_string("level=%d/gen=%d/%s", "level", "gen", "component")
    return run.select("level", "gen").distinct().withColumn("component", F.explode(F.lit(parts))).withColumn("path", path)


def compact_two(older: DataFrame, newer: DataFrame, bottom: bool = True) -> DataFrame:
    """Merge of two runs by key: the newer record wins.

    ``bottom``: nothing lies below the two, so where the newer one is the tombstone of an older record both go. Else tombstones stay, for a
    deeper record would come back.
    """
    cols = ["value", "tombstone", "ts", "crc"]
    o = older.select("key", F.struct(*cols).alias("o"))
    n = newer.select("key", F.struct(*cols).alias("n"))
    both = o.join(n, "key", "full_outer")
    if bottom:
        both = both.where(~(F.col("o").isNotNull() & F.coalesce(F.col("n.tombstone"), F.lit(False))))
    return both.select("key", F.coalesce("n", "o").alias("r")).select("key", "r.*")


def compact(run: DataFrame, bottom: bool) -> DataFrame:
    """Merge of any number of runs: the newest record of each key. Tombstones go only when the oldest runs take part (``bottom``)."""
    newest = F.max_by(F.struct("value", "tombstone", "ts", "crc", "gen"), "gen")
    merged = run.groupBy("key").agg(newest.alias("r")).select("key", "r.*")
    return merged.where("not tombstone") if bottom else merged


def layered_get(ops: DataFrame, run: DataFrame, keys: DataFrame) -> DataFrame:
    """Lookup over layers, newest first: buffer (the log's last day), then runs by level and falling generation.

    key, status, value, layer (0: buffer, else 1,000,000 * level - gen).
    """
    last_day = ops.agg(F.max(day_number("ts")).alias("d"))
    buffer = kv.latest(ops.withColumn("d", day_number("ts")).join(F.broadcast(last_day), "d"))
    layers = (
        buffer.select("key", F.lit(0).alias("level"), F.lit(0).alias("newest"), F.lit(0).alias("layer"), "value", (F.col("op") == "delete").alias("tombstone"))
        .unionByName(run.join(F.broadcast(last_day), F.col("gen") < F.col("d")).select("key", "level", (-F.col("gen")).alias("newest"), (1_000_000 * F.col("level") - F.col("gen")).alias("layer"), "value", "tombstone"))
    )
    found = layers.groupBy("key").agg(F.min_by(F.struct("layer", "value", "tombstone"), F.struct("level", "newest")).alias("f"))
    out = keys.join(found, "key", "left")
    state = F.when(F.col("f").isNull(), "MISSING").when(F.col("f.tombstone"), "DELETED").otherwise("FOUND")
    return out.select("key", state.alias("status"), F.when(~F.col("f.tombstone"), F.col("f.value")).alias("value"), F.col("f.layer").alias("layer"))


def merkle_nodes(leaves: DataFrame, by: list[str]) -> DataFrame:
    """Every node of each group's tree over its values in order: by..., n_leaves, n, slot, hash.

    leaves: by..., slot (0, 1, ...), value. Leaves are sha1 of the value, padded with sha1('') to a
    multiple of 4; with n of them, node n + j joins nodes 2j and 2j + 1, the root is node 2n - 2. Each round
    joins all pairs that are complete, halving the nodes, and is written, so a group of any size is spread over tasks.
    """
    sizes = leaves.groupBy(*by).agg(F.count(F.lit(1)).alias("n_leaves")).withColumn("n", (F.ceil(F.col("n_leaves") / 4) * 4).cast("bigint"))
    largest = sizes.agg(F.max("n")).head()[0] or 0
    pads = sizes.where("n > n_leaves").select(*by, "n_leaves", "n", F.explode(F.sequence(F.col("n_leaves"), F.col("n") - 1)).alias("slot"), F.sha1(F.lit("").cast("binary")).alias("hash"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    sized = leaves.join(sizes.select(*(F.col(c).alias(f"_{c}") for c in by), "n_leaves", "n"), on)
    first = sized.select(*by, "n_leaves", "n", F.col("slot").cast("bigint").alias("slot"), F.sha1(F.coalesce(F.col("value").cast("binary"), F.lit("").cast("binary"))).alias("hash")).unionByName(pads)
    nodes = storage.materialize(first, "merkle")
    found = [nodes]
    for _ in range(int(largest).bit_length() + 1 if largest else 0):
        left = F.col("slot") % 2 == 0
        paired = nodes.groupBy(*by, "n_leaves", "n", (F.col("n") + F.floor(F.col("slot") / 2)).cast("bigint").alias("parent")).agg(F.max(F.when(left, F.col("hash"))).alias("l"), F.max(F.when(~left, F.col("hash"))).alias("r"))
        both = F.col("l").isNotNull() & F.col("r").isNotNull()
        joined = paired.select(
            *by,
            "n_leaves",
            "n",
            F.when(both, F.col("parent")).otherwise(2 * (F.col("parent") - F.col("n")) + F.col("l").isNull().cast("bigint")).alias("slot"),
            F.when(both, F.sha1(F.concat(F.unhex("l"), F.unhex("r")))).otherwise(F.coalesce("l", "r")).alias("hash"),
            both.alias("new"),
        )
        nodes = storage.materialize(joined, "merkle")
        found.append(nodes.where("new").drop("new"))
        nodes = nodes.drop("new")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def merkle_roots(leaves: DataFrame, by: list[str]) -> DataFrame:
    """Root of each group's tree: by..., n_leaves, root."""
    return merkle_nodes(leaves, by).where("slot = 2 * n - 2").select(*by, "n_leaves", F.col("hash").alias("root"))


def merkle_verify(nodes: DataFrame, by: list[str]) -> DataFrame:
    """by..., nodes, bad: the nodes of saved trees, and how many aren't the hash of the two below them or lack these."""
    parents = nodes.where("slot >= n").select(*by, "n", "slot", "hash")
    below = nodes.where("slot < 2 * n - 2").select(*by, "n", (F.col("n") + F.floor(F.col("slot") / 2)).cast("bigint").alias("slot"), F.struct((F.col("slot") % 2).alias("side"), "hash").alias("child"))
    made = below.groupBy(*by, "n", "slot").agg(F.array_sort(F.collect_list("child")).alias("c")).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("slot").alias("_slot"), F.sha1(F.concat(F.unhex(F.col("c")[0]["hash"]), F.unhex(F.try_element_at("c", F.lit(2))["hash"]))).alias("made"))
    on = F.col("slot") == F.col("_slot")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    wrong = parents.join(made, on, "left").groupBy(*by).agg(F.count_if(~F.coalesce(F.col("made") == F.col("hash"), F.lit(False))).alias("bad"), F.count(F.lit(1)).alias("inner"))
    return wrong.select(*by, (2 * F.col("inner") + 1).alias("nodes"), "bad")


def run_leaves(run: DataFrame) -> DataFrame:
    """Values of each run in key order, for ``merkle_roots``."""
    return running(run, ["level", "gen"], ["key"], {"slot": F.lit(1)}).select("level", "gen", "slot", "value")


_RUNS = f"""WITH {SQL},
  runs AS (SELECT 1 AS level, date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS gen, key, last(struct_pack(op := op, value := value, ts := ts) ORDER BY ts, seq) AS l FROM ops GROUP BY ALL),
  run AS (SELECT level, gen, key, l.value AS value, l.op = 'delete' AS tombstone, l.ts AS ts FROM runs)"""
_N = f"WITH {SQL}, n AS (SELECT *, row_number() OVER (ORDER BY ts, seq) AS n FROM ops)"

ORACLES = {
    "wal_segments": _N + " SELECT seq, (n - 1) // 5 + 1 AS segment, key, op FROM n",
    "wal_replay": _N + """, r AS (SELECT key, arg_max(struct_pack(op := op, value := value, seq := seq), n) AS l, (max(n) - 1) // 5 + 1 AS segment FROM n GROUP BY key)
      SELECT key, l.op = 'delete' AS tombstone, CASE WHEN l.op = 'put' THEN l.value END AS value, l.seq AS seq, segment FROM r""",
    "sstable_index": _RUNS + """ SELECT level, gen, key,
        coalesce(sum(29 + strlen(key) + strlen(value)) OVER w, 0)::BIGINT AS data_offset, coalesce(sum(16 + strlen(key)) OVER w, 0)::BIGINT AS index_offset
      FROM run WINDOW w AS (PARTITION BY level, gen ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "sstable_summary": _RUNS + " SELECT level, gen, min(key) AS first_key, max(key) AS last_key, count(*) AS n_keys, count(*) FILTER (tombstone) AS n_tombstones FROM run GROUP BY level, gen",
    "generation_discovery": _RUNS + " SELECT level, max(gen) AS newest FROM run GROUP BY level",
    "run_manifest": _RUNS + """ SELECT DISTINCT level, gen, component, 'level=' || level || '/gen=' || gen || '/' || component AS path
      FROM run, (SELECT unnest(['Data', 'Index', 'Summary', 'Filter', 'Metadata', 'TOC']) AS component)""",
    "compact_two_runs": _RUNS + """ SELECT key, CASE WHEN n.key IS NOT NULL THEN n.value ELSE o.value END AS value, coalesce(n.tombstone, o.tombstone) AS tombstone, coalesce(n.ts, o.ts) AS ts
      FROM (SELECT * FROM run WHERE gen = 19723) o FULL JOIN (SELECT * FROM run WHERE gen = 19724) n USING (key)
      WHERE NOT (o.ts IS NOT NULL AND coalesce(n.tombstone, false))""",
    "compact_kway": _RUNS + " SELECT key, arg_max(value, gen) AS value, arg_max(ts, gen) AS ts, max(gen) AS gen FROM run GROUP BY key HAVING NOT arg_max(tombstone, gen)",
    "lsm_layered_get": _RUNS + """, d AS (SELECT max(date_diff('day', DATE '1970-01-01', ts::DATE))::INT AS d FROM ops),
      layers AS (SELECT key, CASE WHEN gen = d THEN 0 ELSE 1000000 * level - gen END AS layer, value, tombstone FROM run, d),
      found AS (SELECT key, min(layer) AS layer, arg_min(struct_pack(v := value), layer).v AS value, arg_min(tombstone, layer) AS tombstone FROM layers GROUP BY key)
      SELECT k.key, CASE WHEN layer IS NULL THEN 'MISSING' WHEN tombstone THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN NOT tombstone THEN value END AS value, layer
      FROM (SELECT c_custkey::VARCHAR AS key FROM customer) k LEFT JOIN found USING (key)""",
    "merkle_root": _RUNS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
      l AS (SELECT level, gen, list(sha1(coalesce(value, '')) ORDER BY key) AS h FROM run GROUP BY level, gen),
      p AS (SELECT level, gen, len(h) AS n_leaves, list_concat(h, list_transform(range((-len(h)) % 4 + CASE WHEN (-len(h)) % 4 < 0 THEN 4 ELSE 0 END), lambda x: sha1(''))) AS h FROM l),
      m AS (SELECT level, gen, n_leaves, len(h) AS n, h, 0 AS j FROM p
            UNION ALL SELECT level, gen, n_leaves, n, list_append(h, sha1(unhex(h[2 * j + 1]) || unhex(h[2 * j + 2]))), j + 1 FROM m WHERE j < n - 1)
      SELECT level, gen, n_leaves, h[2 * n - 1] AS root FROM m WHERE j = n - 1""",
    "merkle_verify": _RUNS + " SELECT level, gen, 2 * (ceil(count(*) / 4)::BIGINT * 4) - 1 AS nodes, 0::BIGINT AS bad FROM run GROUP BY level, gen",
}
