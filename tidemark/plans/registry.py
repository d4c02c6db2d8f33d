"""Name -> query and name -> DuckDB oracle of the keyed-table engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..config import Config
from ..operators import admission, flush, kv, lsm, sketches, text
from ..sources import oplog
from ..sources import sketches as saved
from ..sources.oplog import read_events
from ..streaming import oplog_stream

CONFIG = Config()
LIMITED = Config(tokenbucket_size=3, tokenbucket_interval=86_400)
BUCKET = (LIMITED.tokenbucket_size, LIMITED.tokenbucket_interval)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ops(spark, d):
    return read_events(spark, d)


def _puts(spark, d):
    return _ops(spark, d).where("op = 'put'")


def _asked(spark, d):
    return _table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))


def _runs(spark, d):
    return lsm.runs(_ops(spark, d))


def _buffers(spark, d):
    """Written once, for level 0 and level 1 are both taken from it."""
    return storage.materialize(flush.buffers(flush.generations(_ops(spark, d), CONFIG)), "buffers")


def _levels(spark, d):
    return flush.cascade(_buffers(spark, d).where("level = 1"), CONFIG)


def _levels_get(spark, d):
    found = _buffers(spark, d)
    return flush.lookup(found.where("level = 0"), flush.cascade(found.where("level = 1"), CONFIG), _asked(spark, d))


def _resumed(spark, d):
    """The last month, with the buckets as the months before left them."""
    ops = _ops(spark, d)
    month = ops.agg(F.date_trunc("month", F.max("ts")).alias("month"))  # one row
    cut = ops.crossJoin(F.broadcast(month))
    cost = admission.cost_of(F.col("op"))
    folder = storage.scratch(spark, "bucket-states")
    oplog.write_bucket_states(admission.bucket_states(cut.where("ts < month"), *BUCKET, cost), folder)
    states = oplog.read_bucket_states(spark, folder).withColumnRenamed("user", "key")
    return admission.token_bucket(cut.where("ts >= month"), *BUCKET, cost, states)


def _saved(spark, d, kind, make, **params):
    """Sketches of two parts of the puts, saved, loaded and merged."""
    puts, path = _puts(spark, d), storage.scratch(spark, "sketches")
    clicks = F.col("category") == "click"
    for name, part in (("clicks", puts.where(clicks)), ("others", puts.where(~clicks))):
        saved.save(make(part), path, kind, name, **params)
    return saved.merge(kind, *(saved.load(spark, path, kind, name, **params) for name in ("clicks", "others")))


def _saved_trees(spark, d):
    path = storage.scratch(spark, "trees")
    saved.save(lsm.merkle_nodes(lsm.run_leaves(_runs(spark, d)), ["level", "gen"]), path, "merkle", "runs")
    return lsm.merkle_verify(saved.load(spark, path, "merkle", "runs"), ["level", "gen"])


def _two(spark, d):
    r = _runs(spark, d)
    return lsm.compact_two(r.where("gen = 19723"), r.where("gen = 19724")).drop("crc")


def _stream(spark, d):
    events = _table(spark, d, "events")
    return oplog_stream.read_stream(spark, d, events.schema, pattern="events.parquet")


def _stream_snapshot(spark, d):
    out = oplog_stream.drain(oplog_stream.latest_stream(_stream(spark, d)), storage.scratch(spark, "snapshot"), "complete")
    return out.where("op <> 'delete'").drop("op")


def _stream_bucket(spark, d):
    return oplog_stream.drain(oplog_stream.token_bucket_stream(_stream(spark, d), *BUCKET), storage.scratch(spark, "bucket"), "append")


def _stream_cms(spark, d):
    return oplog_stream.drain(oplog_stream.cms_stream(_stream(spark, d), CONFIG.cms_epsilon, CONFIG.cms_delta), storage.scratch(spark, "cms"), "complete")


_CMS = (CONFIG.cms_epsilon, CONFIG.cms_delta)

QUERIES = {
    "kv_snapshot": lambda s, d: kv.snapshot(_ops(s, d)),
    "kv_get": lambda s, d: kv.get(read_events(s, d, "7"), "7"),
    "kv_multi_get_status": lambda s, d: kv.multi_get(_ops(s, d), _asked(s, d)),
    "kv_delete_effects": lambda s, d: kv.delete_effects(_ops(s, d)),
    "kv_tombstones": lambda s, d: kv.tombstones(_ops(s, d)),
    "kv_ordered_scan": lambda s, d: kv.ordered_scan(_ops(s, d)),
    "kv_overwrite_count": lambda s, d: kv.overwrites(_ops(s, d)),
    "kv_history": lambda s, d: kv.history(_ops(s, d)),
    "wal_segments": lambda s, d: lsm.wal_segments(_ops(s, d), CONFIG.wal_size),
    "wal_replay": lambda s, d: lsm.wal_replay(_ops(s, d), CONFIG.wal_size),
    "wal_record_crc": lambda s, d: lsm.wal_records(_ops(s, d)),
    "flush_plan": lambda s, d: flush.flush_plan(_ops(s, d), CONFIG),
    "lsm_flush_runs": lambda s, d: _buffers(s, d).drop("crc"),
    "lsm_cascade": lambda s, d: _levels(s, d).drop("crc"),
    "lsm_levels_get": _levels_get,
    "sstable_index": lambda s, d: lsm.run_index(_runs(s, d)),
    "sstable_summary": lambda s, d: lsm.run_summary(_runs(s, d)),
    "generation_discovery": lambda s, d: lsm.newest_generation(_runs(s, d)),
    "run_manifest": lambda s, d: lsm.manifest(_runs(s, d)),
    "compact_two_runs": _two,
    "compact_kway": lambda s, d: lsm.compact(_runs(s, d), True).select("key", "value", "ts", "gen"),
    "lsm_layered_get": lambda s, d: lsm.layered_get(_ops(s, d), _runs(s, d), _asked(s, d)),
    "merkle_root": lambda s, d: lsm.merkle_roots(lsm.run_leaves(_runs(s, d)), ["level", "gen"]),
    "bloom_sizing": lambda s, d: sketches.bloom_sizing(_runs(s, d), CONFIG.bloom_rate),
    "bloom_semi_join": lambda s, d: sketches.bloom_semi_join(_table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name")), _ops(s, d), CONFIG.bloom_rate),
    "cms_matrix": lambda s, d: sketches.cms_matrix(_puts(s, d), *_CMS),
    "cms_frequency": lambda s, d: sketches.cms_frequency(_puts(s, d), _asked(s, d), *_CMS),
    "cms_named": lambda s, d: sketches.cms_frequency(_puts(s, d), _puts(s, d).select("category", "key").distinct(), *_CMS, by=["category"]),
    "cms_bounds": lambda s, d: sketches.cms_bounds(_puts(s, d), *_CMS),
    "hll_registers": lambda s, d: sketches.hll_registers(_puts(s, d), CONFIG.hll_precision),
    "hll_estimate": lambda s, d: sketches.hll_estimate(sketches.hll_registers(_puts(s, d), CONFIG.hll_precision), CONFIG.hll_precision),
    "hll_named": lambda s, d: sketches.hll_estimate(sketches.hll_registers(_puts(s, d), CONFIG.hll_precision, ["category"]), CONFIG.hll_precision, ["category"]),
    "hll_builtin": lambda s, d: sketches.hll_builtin(_puts(s, d), CONFIG.hll_precision, ["category"]),
    "word_frequencies": lambda s, d: text.word_counts(_table(s, d, "documents")),
    "simhash_fingerprint": lambda s, d: text.fingerprints(_table(s, d, "documents")),
    "simhash_pairs": lambda s, d: text.near_pairs(text.fingerprints(_table(s, d, "documents"))),
    "token_bucket": lambda s, d: admission.token_bucket(_ops(s, d), *BUCKET),
    "token_bucket_totals": lambda s, d: admission.admitted_per_key(_ops(s, d), *BUCKET),
    "token_bucket_costs": lambda s, d: admission.token_bucket(_ops(s, d), *BUCKET, admission.cost_of(F.col("op"))),
    "token_bucket_states": lambda s, d: admission.bucket_states(_ops(s, d), *BUCKET, admission.cost_of(F.col("op"))),
    "token_bucket_resumed": _resumed,
    "kv_outcomes": lambda s, d: admission.outcomes(_ops(s, d), *BUCKET),
    "cms_saved": lambda s, d: _saved(s, d, "cms", lambda p: sketches.cms_matrix(p, *_CMS), epsilon=_CMS[0], delta=_CMS[1]),
    "hll_saved": lambda s, d: _saved(s, d, "hll", lambda p: sketches.hll_registers(p, CONFIG.hll_precision), precision=CONFIG.hll_precision),
    "bloom_saved": lambda s, d: _saved(s, d, "bloom", lambda p: sketches.bloom_bits(p, 9586, 7), bits=9586, hashes=7),
    "merkle_verify": _saved_trees,
    "lru_hits": lambda s, d: admission.lru_hits(_ops(s, d), CONFIG.cache_max_size),
    "stream_snapshot": _stream_snapshot,
    "stream_token_bucket": _stream_bucket,
    "stream_cms": _stream_cms,
}

ORACLES: dict[str, str] = kv.ORACLES | lsm.ORACLES | flush.ORACLES | sketches.ORACLES | text.ORACLES | admission.ORACLES
ORACLES |= {
    "stream_snapshot": ORACLES["kv_snapshot"],
    "stream_token_bucket": ORACLES["token_bucket"],
    "stream_cms": ORACLES["cms_matrix"],
    "cms_saved": ORACLES["cms_matrix"],
    "hll_saved": ORACLES["hll_registers"],
}
