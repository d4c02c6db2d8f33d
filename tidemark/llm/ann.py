"""Nearest neighbours by inner product over shifted space-filling curves.

Vectors, lifted by one coordinate so that all have one length and the largest inner
product is the nearest point, are turned, projected, shifted and numbered along a
Hilbert curve, several times over. Each curve is cut into blocks of about equal size by
ranges of its key; a query visits the blocks within a window around its own place
on every curve, and what it finds there is merged and ranked by the exact product.
The window is fitted on a bounded number of queries whose true neighbours are found by comparing them with all rows, so
it shrinks as far as the vectors' structure allows: next to none for vectors without any, which no curve can search
without looking at a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors whose keys tell a key's place on a curve, and queries on which the window is fitted, at most.
SAMPLE, SAMPLE_QUERIES = 12_000, 300
CURVES, DIMENSIONS, BITS = 16, 10, 6
#: Curves that are searched at a time: bounds the copies of the vectors that stand on disk at once.
TOGETHER = 4
#: Rows of a block of a curve at most, and blocks that a window should span about.
BLOCK_ROWS, WINDOW_BLOCKS = 4_000, 6


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of integers below 2**bits (Skilling's transform, all rows at once)."""
    x = points.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), one << np.uint64(bits - 1)
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(b)) & one
    return key


class Curves:
    """The fitted orderings: projections, shifts, and a sample of keys of each that tells a key's place (0 to 1)."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = 3):
        self.longest, self.bits = longest, bits
        rng = np.random.default_rng(seed)
        lifted = self.lift(sample)
        self.turns, self.shifts, self.places = [], [], []
        for _ in range(curves):
            turn = np.linalg.qr(rng.normal(size=(lifted.shape[1],) * 2))[0][:, :dimensions]
            spread = (lifted @ turn).std(axis=0)
            centre = (lifted @ turn).mean(axis=0)
            scale = 1 / np.maximum(8 * spread, 1e-12)
            self.turns.append(turn * scale)
            self.shifts.append(0.5 + rng.uniform(-0.06, 0.06, turn.shape[1]) - centre * scale)
        keys = self.keys(lifted)
        self.places = [np.sort(k) for k in keys]

    def lift(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Rows to length ``longest``: vectors by one more coordinate, queries by a factor."""
        square = np.einsum("ij,ij->i", v, v)
        if query:
            return np.hstack([v * (self.longest / np.sqrt(square))[:, None], np.zeros((len(v), 1))])
        return np.hstack([v, np.sqrt(np.maximum(self.longest**2 - square, 0))[:, None]])

    def keys(self, lifted: np.ndarray) -> list[np.ndarray]:
        top = 1 << self.bits
        return [hilbert_keys(np.clip(((lifted @ t + s) * top).astype(np.int64), 0, top - 1), self.bits) for t, s in zip(self.turns, self.shifts, strict=True)]

    def place(self, lifted: np.ndarray) -> np.ndarray:
        """(curve, row) -> share of the sample before the row's key, between two sampled keys by distance."""
        out = np.empty((len(self.places), len(lifted)))
        for i, (p, k) in enumerate(zip(self.places, self.keys(lifted), strict=True)):
            lo, hi = np.searchsorted(p, k, "left"), np.searchsorted(p, k, "right")
            below, above = p[np.maximum(lo - 1, 0)], p[np.minimum(hi, len(p) - 1)]
            inside = (k - np.minimum(below, k)) / np.maximum(above - below, 1)
            out[i] = np.where(hi > lo, (lo + hi) / 2, np.clip(lo - 0.5 + inside, 0, len(p))) / len(p)
        return out


def true_neighbours(vectors: DataFrame, asked: np.ndarray, curves: Curves, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, places on the curves) of each of the k nearest of a bounded number of queries, by comparing these with all vectors (cid, embedding)."""
    sent = vectors.sparkSession.sparkContext.broadcast((asked, curves))  # bounded by SAMPLE_QUERIES, SAMPLE and CURVES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, curves = sent.value
        best, at = np.full((len(asked), k + 1), -np.inf), np.zeros((len(asked), k + 1, len(curves.turns)))
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1))
                score = np.concatenate([best, asked @ m.T], axis=1)
                keep = np.argpartition(-score, k, axis=1)[:, : k + 1]
                old = keep <= k
                places = curves.place(curves.lift(m)).T
                new = places[np.maximum(keep - k - 1, 0)]
                new[old] = np.take_along_axis(at, np.where(old, keep, 0)[:, :, None], axis=1)[old]
                best, at = np.take_along_axis(score, keep, axis=1), new
        q, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, j]), pa.array(at[q, j].tolist(), pa.list_(pa.float64()))], ["q", "score", "places"])

    found = vectors.select("cid", "embedding").mapInArrow(run, "q int, score double, places array<double>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "places")
    rows = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).collect()  # at most SAMPLE_QUERIES * (k + 1)
    return np.array([r["q"] for r in rows], np.int64), np.array([r["places"] for r in rows]).reshape(len(rows), len(curves.turns))


def fitted_share(vectors: DataFrame, asked: np.ndarray, curves: Curves, k: int, recall: float) -> float:
    """Share of a curve that a window must span to find ``recall`` of the k nearest (and itself) of the queries ``asked``."""
    q, places = true_neighbours(vectors, asked, curves, k)
    own = curves.place(curves.lift(asked, query=True)).T
    apart = np.sort(np.abs(places - own[q]).min(axis=1))
    return min(1.0, 2 * float(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) + 1e-9)


def visits(places: np.ndarray, share: float, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last block, (curve, row), that queries at ``places`` visit. Near an end a window is moved inwards, so it keeps its size."""
    lo, hi = places - share / 2, places + share / 2
    push = np.maximum(-lo, 0) - np.maximum(hi - 1, 0)
    return tuple(np.clip(((x + push) * blocks).astype(np.int64), 0, blocks - 1) for x in (lo, hi))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, embedding of the rows that take part: no nulls, only finite components, not zero, and of the commonest length."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~bad & F.exists("embedding", lambda x: x != 0))
    size = v.groupBy(F.size("embedding").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).head()
    return v.where(F.size("embedding") == (size["s"] if size else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``.

    score is the inner product in double precision, added up in order of the components; ties go to the smaller vec_id. Equal
    vectors are indexed once, with their k + 1 smallest ids, so no group of copies, however large, is searched or
    listed whole, and none of its members that could rank is lost.

    Rows with a null id or vector, with null or non-finite components, zero vectors and vectors not of the
    commonest length take no part. A repeated row counts once; an id with several vectors counts for each as a candidate and gives a list for each as a query.
    With fewer than k candidates all are returned. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    common.tune(spark)
    v = common.materialize(usable(vectors, id_col, vector_col), "vectors")
    first = Window.partitionBy("embedding").orderBy("vec_id")
    members = v.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1).drop("n")
    classes = common.materialize(members.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("cid", F.xxhash64(F.element_at("ids", 1), "embedding")), "vector-classes")
    rows = classes.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not rows:
        return spark.createDataFrame([], schema)
    queries = v.where(F.col("vec_id") % every == 0).distinct()
    asked = queries.select("embedding").distinct()
    # Bounded: SAMPLE vectors, by the smallest hashes.
    sample = _matrix(pa.array([r[0] for r in classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("embedding").collect()], pa.list_(pa.float64())))
    longest = classes.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))).head()[0]
    curves = Curves(sample, longest * (1 + 1e-9))
    share = fitted_share(classes, sample[:SAMPLE_QUERIES], curves, k, recall)
    blocks = min(rows, max(-(-rows // block_rows), int(WINDOW_BLOCKS / share)))
    sent = spark.sparkContext.broadcast(curves)  # bounded by SAMPLE and CURVES
    near = 1e-9 * longest**2  # products that differ by less may come in another order here than by the exact sum

    def deal(query: bool, some: range):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            curves = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                places = curves.place(curves.lift(_matrix(batch.column(1)), query))[some.start : some.stop]
                a, b = visits(places, share if query else 0.0, blocks)
                width = (b - a + 1).T  # (row, curve)
                row = np.repeat(np.arange(batch.num_rows), width.sum(axis=1))
                curve = np.repeat(np.tile(np.arange(some.start, some.stop), batch.num_rows), width.ravel())
                start = np.cumsum(width.ravel()) - width.ravel()
                block = np.arange(len(curve)) - np.repeat(start, width.ravel()) + np.repeat(a.T.ravel(), width.ravel())
                picked = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(curve.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(row), int(query), np.int32)), picked.column(0), picked.column(1)], ["curve", "block", "query", "cid", "embedding"])

        return run

    dealt_ddl = f"curve int, block int, query int, cid bigint, embedding {classes.schema['embedding'].dataType.simpleString()}"

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base_ids, base, ids, matrix = None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            curve, block, query, cid = (batch.column(i).to_numpy() for i in range(4))
            m = _matrix(batch.column(4))
            cuts = np.flatnonzero(np.concatenate(([True], (np.diff(curve) != 0) | (np.diff(block) != 0) | (np.diff(query) != 0), [True])))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = (int(curve[i]), int(block[i]))
                if key != at:
                    at, base_ids, base, ids, matrix = key, [], [], None, None
                if not query[i]:
                    base_ids.append(cid[i:j])
                    base.append(m[i:j])
                    continue
                if not base:
                    continue
                if matrix is None:
                    ids, matrix = np.concatenate(base_ids), np.concatenate(base)
                for s in range(i, j, 256):
                    e = min(s + 256, j)
                    score = m[s:e] @ matrix.T
                    keep = min(k + 1, len(ids))
                    cut = -np.partition(-score, keep - 1, axis=1)[:, keep - 1] - near
                    r, hit = np.nonzero(score >= cut[:, None])
                    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(r, minlength=e - s)))).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(cid[s:e]), pa.ListArray.from_arrays(ends, pa.array(ids[hit])), pa.ListArray.from_arrays(ends, pa.array(score[r, hit]))], ["q", "cids", "scores"])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def close() -> pa.RecordBatch:
            ids = np.concatenate([a for a, _ in held])
            score = np.concatenate([b for _, b in held])
            ids, place = np.unique(ids, return_index=True)
            score = score[place]
            keep = min(k + 1, len(ids))
            hit = score >= -np.partition(-score, keep - 1)[keep - 1] - near
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([ids[hit]], pa.list_(pa.int64())), pa.array([score[hit]], pa.list_(pa.float64()))], ["q", "cids", "scores"])

        for batch in batches:
            for q, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if held and q != at:
                    yield close()
                    held = []
                at = q
                held.append((a.values.to_numpy(), b.values.to_numpy()))
        if held:
            yield close()

    n = common.partitions(spark)
    found_ddl = "q bigint, cids array<bigint>, scores array<double>"
    plain = classes.select("cid", "embedding")
    askers = asked.join(plain, "embedding").select("cid", "embedding")

    def merged(found: DataFrame) -> DataFrame:
        return found.repartition(n, "q").sortWithinPartitions("q").mapInArrow(merge, found_ddl)

    parts = []
    for i in range(0, CURVES, TOGETHER):
        some = range(i, min(i + TOGETHER, CURVES))
        dealt = plain.mapInArrow(deal(False, some), dealt_ddl).unionByName(askers.mapInArrow(deal(True, some), dealt_ddl))
        found = dealt.repartition(n, "curve", "block").sortWithinPartitions("curve", "block", "query").mapInArrow(search, found_ddl)
        parts.append(common.materialize(merged(found), "neighbours"))
    every_part = parts[0]
    for part in parts[1:]:
        every_part = every_part.unionByName(part)
    top = merged(every_part).select("q", F.explode("cids").alias("cid"))
    # One fixed sum for every pair, whatever block it met in.
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    pairs = top.join(plain.select(F.col("cid").alias("q"), double("embedding").alias("x")), "q").join(classes.select("cid", "ids", double("embedding").alias("y")), "cid")
    exact = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = pairs.select("q", exact.alias("score"), F.explode("ids").alias("vec_id")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    by_id = queries.join(plain, "embedding").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("q"))
    mine = by_id.join(lists, "q").where("vec_id <> query_id")
    final = Window.partitionBy("query_id", "q").orderBy("place")
    return mine.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))
