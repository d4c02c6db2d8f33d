"""The keyed-table engine: golden scenario, integrity roots, properties of sketches, stream and batch."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F
from tidemark.config import Config
from tidemark.functions.scalar import ascii_binary, hamming, trailing_zeros, value_crc
from tidemark.operators import admission, flush, kv, lsm, sketches, text
from tidemark.operators.order import running
from tidemark.plans.registry import ORACLES, QUERIES
from tidemark.sources import oplog
from tidemark.sources import sketches as saved
from tidemark.streaming import oplog_stream

SF = "/root/testdata/sf0.001"


def scenario():
    """The built-in scenario as (op, key number, value)."""
    put, delete = "put", "delete"
    head = [(put, k, f"vrednost{k}") for k in range(1, 8)]
    block = [(put, 8, "vrednost8"), (delete, 3, ""), *((put, k, f"vrednost{k}") for k in range(10, 15)), (delete, 15, ""), (delete, 5, ""), (delete, 6, ""), (put, 18, "vrednost18"), (delete, 8, ""), *((put, k, f"vrednost{k}") for k in (20, 21, 30)), *((put, k, f"vrednost{k}") for k in range(23, 28)), (put, 1, "vrednost01"), (put, 28, "vrednost28")]
    middle = [(put, k, f"vrednost{k}") for k in range(31, 38)]
    second = [(delete, 7, "") if x[:2] == (delete, 3) else x for x in block]
    again = [(put, k, "nova_vrednost2" if k == 2 else f"vrednost{k}") for k in range(1, 8)]
    return head + block + middle + second + again + block


@pytest.fixture(scope="module")
def log(spark):
    rows = [(f"kljuc{k:02d}", op, v, 1_700_000_000, i, "default") for i, (op, k, v) in enumerate(scenario())]
    return spark.createDataFrame(rows, "key string, op string, value string, t long, seq long, category string").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_scenario_lookups(spark, log):
    asked = spark.createDataFrame([(f"kljuc{k:02d}",) for k in range(1, 38)], "key string")
    got = {int(r["key"][5:]): (r["status"], r["value"]) for r in kv.multi_get(log, asked).collect()}
    for k in range(1, 38):
        if k == 1:
            want = ("FOUND", "vrednost01")
        elif k == 2:
            want = ("FOUND", "nova_vrednost2")
        elif k in (3, 5, 6, 8):
            want = ("DELETED", None)
        elif k in (9, 16, 17, 19, 22, 29):
            want = ("MISSING", None)
        elif k == 15:
            want = ("DELETED", None)
        else:
            want = ("FOUND", f"vrednost{k}")
        assert got[k] == want, k


def test_scenario_delete_effects(log):
    got = [(int(r["key"][5:]), r["effective"]) for r in kv.delete_effects(log).orderBy("seq").collect()]
    assert got == [(3, True), (15, False), (5, True), (6, True), (8, True), (7, True), (15, False), (5, False), (6, False), (8, True), (3, True), (15, False), (5, True), (6, True), (8, True)]


def test_scenario_flushes(log):
    plan = flush.flush_plan(log, Config()).orderBy("gen").collect()
    assert sum(r["flushed"] for r in plan) == 11 and Config().flush_keys == 7
    assert all(r["n_keys"] >= 7 for r in plan if r["flushed"]) and not any(r["flushed"] for r in plan[11:])


def plain_flushes(rows, limit):
    """(seq -> gen, gens flushed), an operation at a time."""
    live, held, gen, out, done = set(), set(), 1, {}, []
    for seq, key, op in rows:
        if op == "delete" and key not in live:
            continue
        (live.add if op == "put" else live.discard)(key)
        held.add(key)
        out[seq] = gen
        if op == "put" and len(held) >= limit:
            done.append(gen)
            gen, held = gen + 1, set()
    return out, done


@pytest.mark.parametrize(("keys", "deletes", "limit"), [(40, 0.2, 7), (9, 0.4, 7), (6, 0.1, 7), (30, 0.7, 3), (200, 0.3, 1)])
def test_flushes_equal_plain_buffer(spark, keys, deletes, limit):
    rng = random.Random(keys)
    rows = [(i, f"k{int(rng.triangular(0, keys, 1))}", "delete" if rng.random() < deletes else "put") for i in range(900)]
    want, done = plain_flushes(rows, limit)
    ops = spark.createDataFrame([(k, op, "v", i // 7, i, "c") for i, k, op in rows], "key string, op string, value string, t long, seq long, category string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = flush.generations(ops.repartition(5), Config(memtable_size=limit, memtable_threshold=100)).collect()
    assert {r["seq"]: r["gen"] for r in got} == want
    assert sorted(r["gen"] for r in got if r["closes"]) == done


def test_cascade_brings_the_golden_roots(spark, log):
    # The scenario after two more puts, whose values are unknown, with merges that annihilate: the stored runs of level 3.
    more = spark.createDataFrame([(f"z{i}", "put", "?", i - 9, "default") for i in range(2)], "key string, op string, value string, seq long, category string").withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000)))
    # A delete brings a value along, which stays with its tombstone.
    whole = log.withColumn("value", F.when(F.col("op") == "delete", F.concat(F.lit("vrednost"), F.substring("key", 6, 2).cast("int"))).otherwise(F.col("value"))).unionByName(more)
    run = flush.buffers(flush.generations(whole, Config())).where("level = 1")
    merged = flush.cascade(run, Config(), annihilate=True)
    roots = {(r["level"], r["gen"]): r["root"] for r in lsm.merkle_roots(lsm.run_leaves(merged), ["level", "gen"]).collect()}
    assert (roots[3, 2], roots[3, 3]) == ("8891369e3c82ee2a25284d86f47421c2150d6c47", "111ef06ecc4e33b6f44e2d4f0cc0996eb5490c5b")


def test_levels_hold_the_state(spark, log):
    for config in (Config(), Config(lsm_max_lvl=4, lsm_merge_threshold=3, memtable_size=3), Config(lsm_max_lvl=1)):
        found = flush.buffers(flush.generations(log, config))
        runs = flush.cascade(found.where("level = 1"), config)
        asked = spark.createDataFrame([(f"kljuc{k:02d}",) for k in range(1, 40)], "key string")
        got = {r["key"]: (r["status"], r["value"]) for r in flush.lookup(found.where("level = 0"), runs, asked).collect()}
        want = {r["key"]: r["value"] for r in kv.snapshot(log).collect()}
        assert {k: v for k, (s, v) in got.items() if s == "FOUND"} == want
        assert all(r["level"] <= config.lsm_max_lvl for r in runs.select("level").distinct().collect())


def test_a_tombstone_hides_what_lies_deeper(spark):
    cols = "level int, gen long, key string, value string, tombstone boolean, ts long, crc long"
    runs = spark.createDataFrame([(1, g, "a", f"{g}", g == 6, g, 0) for g in (1, 5, 6)] + [(1, g, f"k{g}", "x", False, g, 0) for g in range(1, 8)], cols)
    kept, back = (flush.cascade(runs, Config(), annihilate=x) for x in (False, True))
    none = runs.limit(0)
    asked = spark.createDataFrame([("a",)], "key string")
    assert flush.lookup(none, kept, asked).head()["status"] == "DELETED" and flush.lookup(none, back, asked).head()["value"] == "1"


@pytest.mark.parametrize(
    ("keys", "second", "root"),
    [
        ([1, 7, *range(10, 15), 18, 20, 21, *range(23, 29), *range(30, 38)], None, "8891369e3c82ee2a25284d86f47421c2150d6c47"),
        ([1, 2, 4, 7, *range(10, 15), 18, 20, 21, *range(23, 29), 30], "nova_vrednost2", "111ef06ecc4e33b6f44e2d4f0cc0996eb5490c5b"),
    ],
)
def test_merkle_golden_roots(spark, keys, second, root):
    value = lambda k: "vrednost01" if k == 1 else second if k == 2 and second else f"vrednost{k}"
    leaves = spark.createDataFrame([("g", i, value(k)) for i, k in enumerate(keys)], "g string, slot long, value string")
    (row,) = lsm.merkle_roots(leaves, ["g"]).collect()
    assert (row["root"], row["n_leaves"]) == (root, len(keys))


def test_merkle_empty(spark):
    assert lsm.merkle_roots(spark.createDataFrame([], "g string, slot long, value string"), ["g"]).count() == 0


def test_simhash_golden_distances(spark):
    docs = spark.createDataFrame([(1, "It is a very nice day today"), (2, "It was a very nice day yesterday"), (3, "Banana is a healthy fruit"), (4, "the and"), (5, None), (6, "a  b")], "doc_id long, text string")
    f = text.fingerprints(docs)
    w = [f"w{i}" for i in range(4)]
    pairs = f.alias("x").crossJoin(f.alias("y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), hamming([F.col(f"x.{c}") for c in w], [F.col(f"y.{c}") for c in w]).alias("d"))
    d = {(r["a"], r["b"]): r["d"] for r in pairs.collect()}
    assert (d[1, 2], d[1, 3], d[2, 3]) == (27, 82, 73)
    assert f.where("id = 4").select(*w).head() == (0, 0, 0, 0)
    assert {(r["word"], r["n"]) for r in text.word_counts(docs.where("doc_id = 6")).collect()} == {("", 1), ("b", 1)}
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) >= 120


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.getrandbits(63) for _ in range(4)] for _ in range(5)]
    rows = []
    for i in range(60):
        w = list(base[i % 5])
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(4)] ^= 1 << rng.randrange(63)
        rows.append((i, *w))
    got = {(r["id_a"], r["id_b"], r["distance"]) for r in text.near_pairs(spark.createDataFrame(rows, "id long, w0 long, w1 long, w2 long, w3 long")).collect()}
    names = {}
    for i, *w in rows:
        names.setdefault(tuple(w), i)
    want = {(a, b, d) for wa, a in names.items() for wb, b in names.items() if a < b and (d := sum((x ^ y).bit_count() for x, y in zip(wa, wb, strict=True))) <= 7}
    assert got == want and want


def test_snapshot_ignores_partitioning_and_compaction(spark, log):
    want = {r["key"]: r["value"] for r in kv.snapshot(log).collect()}
    shuffled = log.orderBy(F.rand(5)).repartition(7)
    assert {r["key"]: r["value"] for r in kv.snapshot(shuffled).collect()} == want
    pieces = [lsm.runs(log.where(f"seq % 3 = {k}")) for k in range(3)]
    by_seq = log.groupBy((F.col("seq") / 20).cast("int").alias("gen"), "key").agg(F.max_by(F.struct("op", "value", "ts"), "seq").alias("l")).select(F.lit(1).alias("level"), "gen", "key", F.col("l.value").alias("value"), (F.col("l.op") == "delete").alias("tombstone"), F.col("l.ts").alias("ts"), value_crc(F.col("l.value")).alias("crc"))
    assert {r["key"]: r["value"] for r in lsm.compact(by_seq, True).collect()} == want
    partly = lsm.compact(by_seq.where("gen < 2"), False).withColumn("level", F.lit(2)).unionByName(by_seq.where("gen >= 2"))
    assert {r["key"]: r["value"] for r in lsm.compact(partly, True).collect()} == want
    assert len(pieces) == 3


def test_compaction_of_two_runs(spark):
    cols = "key string, value string, tombstone boolean, ts long, crc long"
    old = spark.createDataFrame([("a", "1", False, 1, 0), ("b", "1", False, 1, 0), ("c", "1", True, 1, 0), ("d", "1", False, 1, 0)], cols)
    new = spark.createDataFrame([("b", "2", False, 2, 0), ("d", "", True, 2, 0), ("e", "", True, 2, 0), ("c", "3", False, 2, 0)], cols)
    got = {r["key"]: (r["value"], r["tombstone"]) for r in lsm.compact_two(old, new).collect()}
    assert got == {"a": ("1", False), "b": ("2", False), "c": ("3", False), "e": ("", True)}
    assert lsm.compact_two(old.where("key = 'd'"), new.where("key = 'd'")).count() == 0
    kept = {r["key"]: r["tombstone"] for r in lsm.compact_two(old, new, bottom=False).collect()}
    assert kept == {"a": False, "b": False, "c": False, "d": True, "e": True}


def test_sketch_properties(spark):
    keys = spark.createDataFrame([(f"k{i % 800}",) for i in range(5000)] + [("é",), ("",)], "key string")
    assert sketches.cms_size(0.01, 0.01) == (272, 6)
    bounds = sketches.cms_bounds(keys, 0.01, 0.01).collect()
    assert len(bounds) == 802 and all(r["estimate"] >= r["exact"] for r in bounds) and sum(r["within"] for r in bounds) >= 790
    est = sketches.hll_estimate(sketches.hll_registers(keys, 12), 12).head()["estimate"]
    assert abs(est - 802) / 802 < 0.06
    assert sketches.hll_estimate(sketches.hll_registers(keys.limit(0), 12), 12).head()["estimate"] == 0
    probe = spark.createDataFrame([(f"k{i}",) for i in range(700, 1500)], "key string")
    assert sketches.bloom_semi_join(probe, keys, 0.01).count() == 100
    run = spark.range(114).select(F.lit(1).alias("level"), F.when(F.col("id") < 100, 1).otherwise(2).alias("gen"))
    assert sorted(map(tuple, sketches.bloom_sizing(run, 0.01).collect())) == [(1, 1, 100, 959, 7), (1, 2, 14, 135, 7)]


def test_scalars(spark):
    row = spark.createDataFrame([("vrednost1", 40)], "v string, n long").select(value_crc(F.col("v")), ascii_binary(F.lit("a1")), trailing_zeros(F.col("n"), 20), trailing_zeros(F.lit(0), 20)).head()
    assert tuple(row) == (zlib.crc32(b"vrednost1"), "0110000100110001", 3, 20)


def test_corrupt_records_are_set_aside(spark):
    rows = spark.createDataFrame([("a", zlib.crc32(b"a")), ("b", 1), (None, 0), ("c", None)], "value string, crc long")
    good, bad = lsm.split_corrupt(rows)
    assert (good.count(), bad.count()) == (2, 2)


def test_running_sum_matches_plain(spark):
    df = spark.createDataFrame([(g, f"{i:03d}", i) for g in ("x", "y", None) for i in range(50)], "g string, k string, v long").repartition(6)
    got = {(r["g"], r["k"]): r["s"] for r in running(df, ["g"], ["k"], {"s": F.col("v")}).collect()}
    assert all(s == sum(range(int(k))) for (_, k), s in got.items()) and len(got) == 150


def test_token_bucket_window_is_anchored(spark):
    rows = [("u", "put", "", t, i, "c") for i, t in enumerate([0, 0, 1, 50, 60, 61, 62, 121, 122])]
    ops = spark.createDataFrame(rows, "key string, op string, value string, t long, seq long, category string").withColumn("ts", F.timestamp_seconds("t"))
    got = [r["admitted"] for r in admission.token_bucket(ops, 2, 60).orderBy("seq").collect()]
    # 60 is within 0's window (strictly more than 60 opens a new one); 61 opens one, 122 the next.
    assert got == [True, True, False, False, False, True, True, False, True]


def test_scenario_leaves_59_tokens(spark, log):
    asked = [(f"kljuc{k:02d}", "get", "", "", 1000 + k) for k in range(1, 38)]
    more = spark.createDataFrame([*asked, ("tasa", "put_special", "x", "new", 2000)], "key string, op string, value string, category string, seq long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_001)))
    one = log.unionByName(more).withColumn("key", F.lit("user"))
    config = Config()
    cost = admission.cost_of(F.col("op"))
    assert [r["admitted"] for r in admission.token_bucket(one, config.tokenbucket_size, config.tokenbucket_interval, cost).select("admitted").distinct().collect()] == [True]
    assert admission.bucket_states(one, config.tokenbucket_size, config.tokenbucket_interval, cost).collect() == [("user", 59, 1_700_000_000)]


def test_buckets_go_on_from_a_state(spark):
    rows = [(u, op, "", t, i, "c") for i, (u, op, t) in enumerate([("a", "put", 10), ("a", "delete", 11), ("a", "put", 12), ("b", "put", 500), ("c", "delete", 5), ("c", "put", 70)])]
    ops = spark.createDataFrame(rows, "key string, op string, value string, t long, seq long, category string").withColumn("ts", F.timestamp_seconds("t"))
    states = spark.createDataFrame([("a", 2, 0), ("b", 0, 400), ("d", 7, 3)], "key string, tokens_left int, last_reset long")
    cost = admission.cost_of(F.col("op"))
    got = [r["admitted"] for r in admission.token_bucket(ops, 3, 60, cost, states).orderBy("seq").collect()]
    # a: two left, one for the put, the delete gets one of two; b: its window is over; c: new.
    assert got == [True, False, False, True, True, True]
    left = {r["key"]: (r["tokens_left"], r["last_reset"]) for r in admission.bucket_states(ops, 3, 60, cost, states).collect()}
    assert left == {"a": (0, 0), "b": (2, 500), "c": (2, 70), "d": (7, 3)}
    outcomes = {r["seq"]: r["outcome"] for r in admission.outcomes(ops, 3, 60).collect()}
    assert outcomes == {0: "STORED", 1: "DELETED", 2: "THROTTLED", 3: "STORED", 4: "MISSING", 5: "STORED"}


def test_saved_sketches_and_trees(spark, tmp_path):
    path = str(tmp_path)
    keys = spark.createDataFrame([(f"k{i % 40}",) for i in range(100)], "key string")
    saved.save(sketches.cms_matrix(keys, 0.1, 0.1), path, "cms", "x", epsilon=0.1, delta=0.1)
    with pytest.raises(ValueError):
        saved.load(spark, path, "cms", "x", epsilon=0.2, delta=0.1)
    back = saved.load(spark, path, "cms", "x", epsilon=0.1, delta=0.1)
    twice = saved.merge("cms", back, back)
    assert {tuple(r) for r in twice.select("row", "bucket", "count").collect()} == {(r["row"], r["bucket"], 2 * r["count"]) for r in back.collect()}
    with pytest.raises(ValueError):
        saved.save(back, path, "other", "x")
    for n in (1, 4, 5, 23):
        leaves = spark.createDataFrame([("g", i, f"v{i}") for i in range(n)], "g string, slot long, value string")
        nodes = lsm.merkle_nodes(leaves, ["g"])
        padded = -(-n // 4) * 4
        assert lsm.merkle_verify(nodes, ["g"]).collect() == [("g", 2 * padded - 1, 0)]
    broken = nodes.withColumn("hash", F.when(F.col("slot") == 3, F.sha1(F.lit("x").cast("binary"))).otherwise(F.col("hash")))
    assert lsm.merkle_verify(broken, ["g"]).head()["bad"] == 1


def test_lru_against_plain(spark):
    rng = random.Random(2)
    trace = [(f"k{int(rng.expovariate(0.2))}", i * 7919) for i in range(900)]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(trace)], "key string, t long, seq long").withColumn("ts", F.timestamp_seconds("t"))
    held, hits = [], {}
    for k, _ in trace:
        hits.setdefault(k, [0, 0])[0] += 1
        if k in held:
            hits[k][1] += 1
            held.remove(k)
        held = [*held, k][-5:]
    assert {r["key"]: [r["accesses"], r["hits"]] for r in admission.lru_hits(df, 5).collect()} == hits


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: oplog_stream.read_stream(spark, str(tmp_path / "in"), events.schema, files_per_trigger=1)
    ops = oplog.from_events(events)
    got = oplog_stream.drain(oplog_stream.latest_stream(stream()), str(tmp_path / "a"), "complete")
    assert {tuple(r) for r in got.select("key", "op", "seq").collect()} == {tuple(r) for r in kv.latest(ops).select("key", "op", "seq").collect()}
    counts = oplog_stream.drain(oplog_stream.windowed_counts(stream(), "60 days", "1 day"), str(tmp_path / "c"), "append")
    assert sum(r["n"] for r in counts.collect()) <= events.count()
    ordered = events.repartitionByRange(4, "ts").sortWithinPartitions("ts")
    for i in range(4):
        ordered.where(F.spark_partition_id() == i).coalesce(1).write.parquet(str(tmp_path / f"day{i}"))
    import os
    import shutil

    (tmp_path / "late").mkdir()
    for i in range(4):
        for f in sorted((tmp_path / f"day{i}").glob("*.parquet")):
            shutil.copy(f, tmp_path / "late" / f"{i}-{f.name}")
            os.utime(tmp_path / "late" / f"{i}-{f.name}", (1000 + i, 1000 + i))
    # Files come one a batch, in order of time: state is carried from batch to batch.
    batches = oplog_stream.read_stream(spark, str(tmp_path / "late"), events.schema, files_per_trigger=1)
    got = oplog_stream.drain(oplog_stream.token_bucket_stream(batches, 3, 86_400), str(tmp_path / "t"), "append")
    assert len(list((tmp_path / "t" / "data").glob("batch=*"))) == 4
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in admission.token_bucket(ops, 3, 86_400).collect()}


def test_log_round_trip_and_runs_on_disk(spark, tmp_path, log):
    oplog.append(log, str(tmp_path / "log"))
    oplog.append(log.limit(3), str(tmp_path / "log"))
    assert oplog.read(spark, str(tmp_path / "log")).count() == log.count() + 3
    oplog.write_run(lsm.runs(log), str(tmp_path / "runs"), 2)
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert back.count() == lsm.runs(log).count() and {"level", "gen"} <= set(back.columns)
    (tmp_path / "users.csv").write_text("ana,x,5,100\nbo,y,0,200\n")
    assert [tuple(r) for r in oplog.read_bucket_states(spark, str(tmp_path / "users.csv")).collect()] == [("ana", 5, 100), ("bo", 0, 200)]


def test_config_text():
    c = Config.from_text("wal_size: 9\ncmsEpsilon: 1\nhll_precision: 4 # small\nwal_lwm: 3\n")
    assert (c.wal_size, c.cms_epsilon, c.hll_precision) == (9, 0.01, 4)
    with pytest.raises(ValueError):
        Config.from_text("speed: 3")
    assert math.ceil(Config(memtable_size=3).flush_keys) == 3


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) - set(ORACLES) == {"wal_record_crc", "hll_builtin"}


def test_records_equal_zlib(spark):
    rows = QUERIES["wal_record_crc"](spark, SF).join(spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id seq", "props"), "seq").collect()
    assert rows and all(r["crc"] == zlib.crc32(r["props"].encode()) and r["bytes"] == 29 + r["key_size"] + r["value_size"] for r in rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path, log):
    p = plan(QUERIES["kv_get"](spark, SF))
    assert "EqualTo(user_id,7)" in p and "value" not in p.split("ReadSchema:")[1].split("\n")[0]
    assert oplog.read_events(spark, SF, "x").count() == 0 and oplog.read_events(spark, SF, "07").count() == 0
    oplog.append(log, str(tmp_path / "log"))
    p = plan(kv.get(oplog.read(spark, str(tmp_path / "log")), "kljuc02"))
    assert "EqualTo(key,kljuc02)" in p and "category" not in p.split("ReadSchema:")[1].split("\n")[0]
    p = plan(kv.overwrites(oplog.read(spark, str(tmp_path / "log"))))
    assert "EqualTo(op,put)" in p and "partial_count" in p
