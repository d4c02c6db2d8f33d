"""Removed passages against brute force."""

import hashlib

import numpy as np
import pytest
from tidemark.llm import common, dedup


def brute(rows):
    """rows: (id, text). Order: id (null last), then hash of the text as the operator has it."""
    import xxhash

    data = [(i, (x or "").encode()) for i, x in rows]
    order = sorted(range(len(data)), key=lambda k: (data[k][0] is None, data[k][0] or 0, xxhash.xxh3_128_digest(data[k][1])))
    seen, out = set(), []
    for k in order:
        i, t = data[k]
        mask = np.zeros(len(t), bool)
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            if w in seen:
                mask[s : s + 100] = True
            seen.add(w)
        runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(t) else 0
        out.append((i, len(t), int(mask.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~mask])).hexdigest()))
    return out


def check(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(x, i, "e", 5) for i, x in rows], "text string, doc_id long, block string, kind int").repartition(parts)
    got = dedup.repeated_spans(df, with_text=True, **how).collect()
    for r in got:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and sum(b - a for a, b in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3], r[4])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(brute(rows), key=key)
    return got


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 7)))) for _ in range(n))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    common_passage, license_line = words(rng, 60), words(rng, 18)[:101]
    rows = []
    for i in range(70):
        t = words(rng, int(rng.integers(5, 120)))
        if i % 3 == 0:
            t = t[:50] + common_passage[: int(rng.integers(90, len(common_passage)))] + t[50:]
        if i % 4 == 0:
            t += "\n" + license_line
        if i % 5 == 0 and rows:
            t += rows[-1][1] or ""
        rows.append((1000 - i * 7, t))
    rows += [(3, rows[2][1]), (4, rows[2][1]), (5, "é" * 120), (6, "z" * 400), (7, "abc" * 150), (8, "zz" + "abc" * 150), (9, "x" * 99), (10, "y" * 100), (11, "y" * 101), (12, None), (13, ""), (14, words(rng, 40) * 3)]
    got = check(spark, rows)
    assert sum(r["n_removed"] for r in got) > 3000


def test_ties_repeats_and_nulls(spark):
    rng = np.random.default_rng(2)
    a, b = words(rng, 60), words(rng, 60)
    check(spark, [(1, a), (1, a), (1, b), (None, a), (None, a), (None, None), (2, a + b), (0, "q" + b)], parts=4)
    check(spark, [(1, a)] * 5, parts=5)
    check(spark, [(i, a) for i in range(40)], parts=4)


def test_empty(spark):
    assert dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_and_hot_passage(spark):
    rng = np.random.default_rng(3)
    passage = words(rng, 40)
    rows = [(i, words(rng, 6) + passage + words(rng, 6)) for i in range(150)] + [(900, words(rng, 9000))]
    check(spark, rows, parts=6)
    check(spark, rows, parts=6, hot_shards=2)
    check(spark, rows[:40] + [(50, "z" * 500), (51, "z" * 300)], parts=4, hot_shards=1)


@pytest.mark.parametrize("n", [0, 31, 68, 69, 70, 500])
def test_window_minimum(n):
    v = np.random.default_rng(n).integers(0, 50, n).astype(np.uint64)
    assert dedup.window_minimum(v, 69).tolist() == [int(v[i : i + 69].min()) for i in range(n - 68)]


def test_window_keys_depend_on_the_window_only():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 256, 100).astype(np.uint8)
    data = np.concatenate([rng.integers(0, 256, 37).astype(np.uint8), w, rng.integers(0, 256, 301).astype(np.uint8), w])
    a, b, c = dedup.window_keys(data, np.array([37, 438, 38]))
    assert a == b != c


def test_slices_bound_memory():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 30, "c"])], ["text"])
    assert [found for _, found in common.slices([batch], "text", 12)] == [[b"a" * 10, b""], [b"b" * 30], [b"c"]]
