"""SimHash near-duplicates: exact pairs within a Hamming radius, in tiles of XOR and bit counts.

Fingerprints are cut into bands so that two within the radius agree on some of
them; each choice of bands deals the distinct fingerprints into buckets. In a
bucket, rows sorted by bit count form tiles, and a pair of tiles whose counts differ by more than the radius is
skipped. A bucket above ``TILE_ROWS`` is dealt out as pairs of chunks. A tile passes on a
forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Rows that one task compares with each other at most.
TILE_ROWS = 8192
TILE = 512


def shingle_hashes(found: list[bytes], width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of the word shingles of texts that have words: (hashes, first hash of each text, the texts)."""
    docs = [x.translate(common.LOWER_TABLE).split() for x in found]
    data = b" ".join(b" ".join(w) for w in docs if w)
    sizes = np.array([len(w) for w in docs], np.int64)
    live = np.flatnonzero(sizes)
    sizes = sizes[live]
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
    first = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - width + 1, 1)
    base = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum())) - np.repeat(base - first, counts)
    last = at + np.repeat(np.minimum(sizes, width) - 1, counts)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[a:b], seed) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(at)), base, live


def shingle_sets(found: list[bytes], width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of texts that have words, rising in each text: (hashes, first hash of each text, the texts)."""
    hashes, base, live = shingle_hashes(found, width, seed)
    owner = np.repeat(np.arange(len(base)), np.diff(base, append=len(hashes)))
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(base))), live


def set_hashes(count: int, hashes: np.ndarray, base: np.ndarray, live: np.ndarray) -> np.ndarray:
    """A hash of each of the ``count`` texts' set of shingles; the same for all texts without words."""
    out = np.full(count, xxhash.xxh64_intdigest(b""), np.uint64)
    ends = np.append(base, len(hashes))
    for i, a, b in zip(live.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out[i] = xxhash.xxh64_intdigest(hashes[a:b])
    return out


#: The bits of a byte, each in a byte of its own, lowest first.
LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Of each run of hashes (starting at ``base``), the bits that more than half of them have.

    The bits of each byte are added eight at a time, in byte lanes that hold sums of up to 255 hashes.
    """
    counts = np.diff(base, append=len(hashes))
    chunks = -(-counts // 255)
    owner = np.repeat(np.arange(len(base)), chunks)
    first_chunk = np.cumsum(chunks) - chunks
    starts = base[owner] + 255 * (np.arange(len(owner)) - first_chunk[owner])
    columns = hashes.view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(base), np.uint64)
    for byte in range(8):
        sums = np.add.reduceat(LANES[columns[:, byte]], starts).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(sums.astype(np.int64), first_chunk, axis=0)
        for k in range(8):
            out |= (2 * ones[:, k] > counts).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def text_fingerprints(found: list[bytes], width: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of each text: majority of XXH64 bits over its word shingles; 0 without words."""
    out = np.zeros(len(found), np.uint64)
    hashes, base, live = shingle_hashes(found, width, seed)
    if live.size:
        out[live] = majority(hashes, base)
    return out


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed integer)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_fingerprints(found, width).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, fp bigint")


def band_masks(rows: int, radius: int) -> list[int]:
    """Masks such that two 64-bit values within ``radius`` agree under one of them at least.

    64 bits in radius + e bands: all but ``radius`` bands agree, so every choice of e bands is
    a mask. e grows with the rows until a bucket of random values holds few.
    """
    for keep in range(1, 5):
        n = radius + keep
        cuts = [64 * i // n for i in range(n + 1)]
        bands = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(n)]
        masks = [sum(c) for c in combinations(bands, keep)]
        if rows >> min(m.bit_count() for m in masks) < 256:
            break
    return masks


def tile_links(fps: np.ndarray, radius: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest (positions a, b) with the links within ``radius`` among fps, or between fps and other.

    Positions count on through ``other``.
    """
    left, right = (fps, fps) if other is None else (fps, other)
    shift = 0 if other is None else len(fps)
    orders = [np.argsort(np.bitwise_count(x), kind="stable") for x in (left, right)]
    l, r = left[orders[0]], right[orders[1]]  # noqa: E741
    lp, rp = np.bitwise_count(l).astype(np.int64), np.bitwise_count(r).astype(np.int64)
    label = np.arange(len(left) if other is None else len(left) + len(right))

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            y = label[x]
            if (y == x).all():
                return x
            x = y

    for i in range(0, len(l), TILE):
        a = l[i : i + TILE]
        for j in range(i if other is None else 0, len(r), TILE):
            b = r[j : j + TILE]
            if rp[j] - lp[min(i + TILE, len(l)) - 1] > radius:
                break
            if lp[i] - rp[min(j + TILE, len(r)) - 1] > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            p, q = orders[0][x + i], orders[1][y + j] + shift
            while True:
                p, q = root(p), root(q)
                apart = p != q
                if not apart.any():
                    break
                p, q = p[apart], q[apart]
                lo, hi = np.minimum(p, q), np.maximum(p, q)
                np.minimum.at(label, hi, lo)
    nodes = np.arange(len(label))
    found = root(nodes)
    apart = found != nodes
    return nodes[apart], found[apart]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """a, b: links that connect all fingerprints (distinct ``fp``) within ``radius`` of each other."""
    masks = band_masks(prints.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for i, m in enumerate(signed)))).alias("k")).select("fp", "k.*")
    sizes = common.materialize(keyed.groupBy("mask", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE_ROWS), "hot-buckets")
    one = F.lit(0)
    if sizes.isEmpty():
        tasks = keyed.select("mask", "bucket", one.alias("i"), one.alias("j"), one.alias("side"), "fp")
    else:
        chunks = F.ceil(F.col("n") / TILE_ROWS).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
        tasks = (
            keyed.join(sizes, ["mask", "bucket"], "left")
            .withColumn("c", F.coalesce(chunks, F.lit(1)))
            .withColumn("own", own)
            .select("mask", "bucket", "own", "fp", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("with"))
            .select("mask", "bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "fp")
        )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, side, fps in _groups(batches):
            if len(fps) < 2:
                continue
            two = group[2] != group[3]
            one, other = (fps[side == 0], fps[side == 1]) if two else (fps, None)
            a, b = tile_links(one, radius, other)
            fps = np.concatenate([one, other]) if two else fps
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], ["a", "b"])

    names = ["mask", "bucket", "i", "j"]
    return tasks.repartition(common.partitions(prints.sparkSession), *names).sortWithinPartitions(*names).mapInArrow(compare, "a bigint, b bigint")


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Runs of equal (mask, bucket, i, j) of sorted rows, across batches: (key, side, fp)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    key: tuple | None = None
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if not len(cols[0]):
            continue
        new = np.ones(len(cols[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])
        cuts = [*np.flatnonzero(new).tolist(), len(new)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(int(c[a]) for c in cols[:4])
            if this != key and held:
                yield key, np.concatenate([s for s, _ in held]), np.concatenate([f for _, f in held])
                held = []
            key = this
            held.append((cols[4][a:b], cols[5][a:b].view(np.uint64)))
    if held:
        yield key, np.concatenate([s for s, _ in held]), np.concatenate([f for _, f in held])


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id: the smallest doc_id reachable over links of fingerprints that differ in at
    most ``radius`` bits. Null and empty texts and texts of white space only have fingerprint 0, which links like any other.
    Null ids count for no minimum; a component of null ids only has a null component_id. Repeated
    rows are one class. An empty table gives no rows. Other columns are ignored.
    """
    common.tune(docs.sparkSession)
    prints = common.materialize(fingerprints(docs, width, id_col, text_col), "simhash")
    classes = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = common.materialize(components(links(classes.select("fp"), radius)), "simhash-roots")
    by_root = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = by_root.groupBy("root").agg(F.min("least").alias("component_id"))
    known = by_root.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Words of 64 bits of a text's parity bits, and of its fine ones at least: these double until they are as many as its shingles.
WIDE = 16
#: Rows that one task compares at most in a bucket, and shingles that it holds when it compares whole sets.
WIDE_ROWS, WIDE_SHINGLES = 2048, 1 << 22
#: Fine parity bits that one task holds.
WIDE_BITS = 1 << 26
#: Documents of the sample that tells frequent shingles from rare ones, and how often a frequent one stands in it.
SAMPLE, FREQUENT = 20_000, 8
#: Columns of a block of the table of texts and shingles.
COLUMNS = 4096


def parity_bits(hashes: np.ndarray, base: np.ndarray, words: int = WIDE) -> np.ndarray:
    """(text, word): bit i tells whether an odd number of the text's shingles have hashes that start with i.

    Two texts differ in no more bits than the shingles that one of them only has.
    """
    bits = 64 * words
    owner = np.repeat(np.arange(len(base)), np.diff(base, append=len(hashes)))
    at = owner * bits + (hashes >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(base) * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(-1, words)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The same texts' parity bits in fewer words: a bit is the parity of those whose hashes it joins."""
    each = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").reshape(len(bits), 64 * words, -1)
    return np.packbits(np.bitwise_xor.reduce(each, axis=2), axis=1, bitorder="little").view(np.uint64)


def fine_bits(hashes: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """Each text's parity bits, in ``WIDE`` words doubled until there are as many bits as shingles."""
    sizes = np.diff(base, append=len(hashes))
    level = np.ceil(np.log2(np.maximum(sizes / (64 * WIDE), 1))).astype(np.int64)
    out: list = [None] * len(base)
    for k in np.unique(level).tolist():
        rows = np.flatnonzero(level == k)
        own = np.cumsum(sizes[rows]) - sizes[rows]
        for i, row in zip(rows.tolist(), parity_bits(hashes[np.repeat(level == k, sizes)], own, WIDE << k), strict=True):
            out[i] = row
    return out


def rare_first(hashes: np.ndarray, base: np.ndarray, similarity: float, frequent: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of each text): each text's rarest shingles, so many that texts at the similarity share one.

    Rare by the times of the ``frequent`` hashes (rising), then by hash. What stands in a sample only sets an order, so it loses no pair.
    """
    sizes = np.diff(base, append=len(hashes))
    owner = np.repeat(np.arange(len(base)), sizes)
    level = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        level = np.where(frequent[at] == hashes, times[at], 0)
    order = np.lexsort((level, owner))
    need = sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1
    place = np.arange(len(hashes)) - np.repeat(base, sizes)
    return hashes[order][place < np.repeat(need, sizes)], need


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, times) of the shingles that stand in many texts of a sample of ``docs`` (text)."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(found, width)[0].view(np.int64))], ["shingle"])

    share = min(1.0, SAMPLE / max(docs.count(), 1))
    found = docs.sample(share, 11).select("text").mapInArrow(count, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    rows = found.orderBy(F.desc("n"), "shingle").limit(100_000).toArrow()
    hashes, times = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], times[order]


def closest_links(fps: np.ndarray, radius: int, sizes: np.ndarray | None = None, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A forest (a, b) of the links within ``radius`` among rows of words, shortest links first.

    With ``sizes`` of the sets whose parity bits the rows are, only links that sets of the similarity may have count.
    So for every distance the forest's links up to it connect what all links up to it connect.
    """
    ones = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    f, ones = fps[order], ones[order]
    small = 64 * fps.shape[1] < 1 << 15
    found = []
    for i in range(0, len(f), TILE):
        for j in range(i, len(f), TILE):
            if ones[j] - ones[min(i + TILE, len(f)) - 1] > radius:
                break
            apart = np.bitwise_count(f[i : i + TILE, None, 0] ^ f[None, j : j + TILE, 0]).astype(np.int16 if small else np.int32)
            for w in range(1, fps.shape[1]):
                apart += np.bitwise_count(f[i : i + TILE, None, w] ^ f[None, j : j + TILE, w])
            x, y = np.nonzero(apart <= radius)
            up = x + i < y + j
            if sizes is not None:
                p, q = sizes[order[x + i]], sizes[order[y + j]]
                up &= (apart[x, y] * (1 + similarity) <= (1 - similarity) * (p + q) + 1e-6) & (np.minimum(p, q) >= similarity * np.maximum(p, q) - 1e-6)
            x, y = x[up], y[up]
            found.append((apart[x, y].astype(np.uint16 if small else np.int32), order[x + i].astype(np.int32), order[y + j].astype(np.int32)))
    d, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(d, kind="stable")
    d, a, b = d[by], a[by], b[by]
    edges = np.append(np.flatnonzero(np.diff(d, prepend=radius + 1)), len(d))
    label = np.arange(len(fps))
    keep: list[tuple[int, int]] = []
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # one distance after another
        p, q = a[start:end], b[start:end]
        apart = label[p] != label[q]
        for u, v in zip(p[apart].tolist(), q[apart].tolist(), strict=True):
            lo, hi = sorted((int(label[u]), int(label[v])))
            if lo != hi:
                label[label == hi] = lo
                keep.append((u, v))
    pairs = np.array(keep, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of sorted rows that are equal in the first columns, across batches: (key, rows)."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns[:keys]]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(int(c[a]) for c in cols)
            if held and this != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = this
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def in_chunks(rows: DataFrame, key: str, chunks: F.Column, *columns: str) -> DataFrame:
    """key, i, j and columns: every two chunks of a key's rows meet under an (i, j) of their own; rows are dealt by ``node``."""
    own = F.pmod(F.xxhash64("node"), F.col("_c")).cast("int")
    dealt = rows.withColumn("_c", chunks.cast("int")).withColumn("_own", own).select(key, "_own", *columns, F.explode(F.sequence(F.lit(0), F.col("_c") - 1)).alias("_with"))
    dealt = dealt.select(key, F.least("_own", "_with").alias("i"), F.greatest("_own", "_with").alias("j"), *columns)
    return dealt.repartition(common.partitions(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")


def ordered_pairs(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    x, y = nodes[a], nodes[b]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def similar_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect all candidates among classes (node, n, bits, rare).

    Sets at the similarity share one of their rarest shingles, are of like size and have like parity bits, so no pair is missed.
    Of the shingles that the same classes hold one is enough.
    """
    keyed = classes.select("node", F.explode("rare").alias("bucket"))
    # Most shingles stand in one class only. Each step is written, so that its shuffle is gone before the next one.
    met = common.materialize(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket"), "wide-met")
    held = common.materialize(keyed.join(met, "bucket"), "wide-held")
    common.discard(met)
    marks = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"))
    sizes = common.materialize(marks.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "wide-buckets")
    shared = held.join(sizes, "bucket").join(classes.select("node", "n", "bits"), "node")
    few = F.when(F.col("size") <= WIDE_ROWS, 1).otherwise(F.ceil(2 * F.col("size") / WIDE_ROWS))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, 3):
            if rows.num_rows > 1:
                bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(-1, WIDE)
                a, b = closest_links(bits, 64 * WIDE, rows.column("n").to_numpy(), similarity)
                if len(a):
                    yield ordered_pairs(rows.column("node").to_numpy(), a, b)

    return in_chunks(shared, "bucket", few, "node", "n", "bits").mapInArrow(compare, "a bigint, b bigint").distinct()


def fine_links(fine: list[bytes], sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all sets whose sizes and fine parity bits the similarity allows.

    Sets at the similarity have fine bits of equal or neighbouring lengths, so each length is compared with itself and with
    the next one folded to it.
    """
    words = np.array([len(x) // 8 for x in fine], np.int64)
    found = []
    for k in np.unique(words).tolist():
        rows, over = np.flatnonzero(words == k), np.flatnonzero((words == 2 * k) & (sizes * similarity <= 64 * k + 1e-6))
        if len(rows) + len(over) < 2:
            continue
        bits = np.frombuffer(b"".join(fine[i] for i in rows), np.uint64).reshape(-1, k)
        if len(over):
            bits = np.concatenate([bits, folded(np.frombuffer(b"".join(fine[i] for i in over), np.uint64).reshape(-1, 2 * k), k)])
        rows = np.concatenate([rows, over])
        most = int((1 - similarity) / (1 + similarity) * 2 * sizes[rows].max() + 1e-6)
        a, b = closest_links(bits, min(most, 64 * k), sizes[rows], similarity)
        found.append((rows[a], rows[b]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*found, strict=True)) if found else (none, none)


def finer_links(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect all sets at the similarity among those that candidate ``pairs`` connect, by fine parity bits.

    ``WIDE`` words tell texts of many more shingles than bits not apart, so such texts make large parts. The parts that hold one
    are compared anew, all members with each other, on bits as many as their shingles; pairs of other parts stay as they are.
    """
    parts = common.materialize(components(pairs).withColumnRenamed("root", "part"), "wide-rough")
    members = parts.join(classes.select("node", "n", F.coalesce("fine", "bits").alias("fine")), "node")
    grown = members.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.sum(F.octet_length("fine").cast("bigint") * 8).alias("total"), F.max("n").alias("longest"))
    grown = common.materialize(grown.where(F.col("longest") > 64 * WIDE).drop("longest"), "wide-grown")
    few = F.when((F.col("size") <= WIDE_ROWS) & (F.col("total") <= WIDE_BITS), 1).otherwise(F.ceil(F.greatest(2 * F.col("size") / WIDE_ROWS, 2 * F.col("total") / WIDE_BITS)))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, 3):
            if rows.num_rows > 1:
                a, b = fine_links(rows.column("fine").to_pylist(), rows.column("n").to_numpy(), similarity)
                if len(a):
                    yield ordered_pairs(rows.column("node").to_numpy(), a, b)

    again = in_chunks(members.join(grown, "part"), "part", few, "node", "n", "fine").mapInArrow(compare, "a bigint, b bigint").distinct()
    whole = parts.join(grown, "part", "left_anti").select(F.col("node").alias("a"))
    return again.unionByName(pairs.join(whole, "a", "left_semi").select("a", "b"))


#: Members that a group of candidates is first compared with, before all that these don't link are compared with all.
CENTRES = 8


def confirmed_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest (a, b) of the links between sets whose resemblance reaches the similarity.

    A few sets are compared with all first; what they link needs no comparison inside. All others are compared with all.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)
    column, owner = place[column], np.repeat(np.arange(len(sets)), sizes)
    column, owner = column[column >= 0], owner[column >= 0]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    group = np.arange(len(sets))
    keep: list[tuple[int, int]] = []

    def link(rows: np.ndarray) -> None:
        shared = np.zeros((len(rows), len(sets)))
        for start in range(0, int((times > 1).sum()), COLUMNS):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[owner[a:b], column[a:b] - start] = 1
            shared += has[rows] @ has.T
        x, y = np.nonzero(shared >= similarity * (sizes[rows, None] + sizes[None, :] - shared))
        x = rows[x]
        apart = group[x] != group[y]
        for u, v in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            if group[u] != group[v]:
                group[group == group[v]] = group[u]
                keep.append((u, v))

    link(np.unique(np.linspace(0, len(sets) - 1, CENTRES).astype(np.int64)))
    _, which, members = np.unique(group, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(which != members.argmax())
    for at in range(0, len(rest), TILE):
        link(rest[at : at + TILE])
    pairs = np.array(keep, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def sure_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect all sets (node, shingles) at the similarity among those that candidate ``pairs`` connect.

    ``pairs`` are a forest, so a link that it leaves out lies inside a part that it connects. A part's sets meet in one place, each sent
    there once (a large part's by pairs of chunks), and all links among them count.
    """
    parts = common.materialize(components(pairs).withColumnRenamed("root", "part"), "wide-parts")
    sized = parts.join(sets.select("node", F.size("shingles").alias("n")), "node").groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    few = F.when((F.col("size") <= WIDE_ROWS) & (F.col("total") <= WIDE_SHINGLES), 1).otherwise(F.ceil(F.greatest(2 * F.col("size") / WIDE_ROWS, 2 * F.col("total") / WIDE_SHINGLES)))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in runs(batches, 3):
            if found.num_rows > 1:
                column = found.column("shingles").combine_chunks()
                ends = column.offsets.to_numpy()
                a, b = confirmed_links(np.split(column.values.to_numpy()[ends[0] : ends[-1]], ends[1:-1] - ends[0]), similarity)
                if len(a):
                    yield ordered_pairs(found.column("node").to_numpy(), a, b)

    dealt = parts.join(sized, "part").join(sets, "node")
    return in_chunks(dealt, "part", few, "node", "shingles").mapInArrow(compare, "a bigint, b bigint")


def similar_groups(docs: DataFrame, key: str, text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """key, group (smallest key of the group): texts linked by a resemblance of word shingles of ``similarity`` or more.

    Filters on the sets of shingles, which miss no pair, find the candidates; each is then confirmed on the exact sets.
    Texts with equal sets of shingles count as one. Null and empty texts are one group. ``key`` must tell the rows apart or be the same for rows to be treated as one.
    """
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    frequent, times = frequent_shingles(named, width)

    def prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in common.slices(batches, "text"):
            hashes, base, live = shingle_sets(found, width)
            count, rare, bits, fine = np.zeros(len(found), np.int64), [[]] * len(found), [b""] * len(found), [None] * len(found)
            if live.size:
                first, need = rare_first(hashes, base, similarity, frequent, times)
                count[live] = np.diff(base, append=len(hashes))
                for i, own, row in zip(live.tolist(), np.split(first.view(np.int64), np.cumsum(need)[:-1]), fine_bits(hashes, base), strict=True):
                    rare[i], bits[i] = own, (folded(row[None], WIDE) if len(row) > WIDE else row).tobytes()
                    if len(row) > WIDE:
                        fine[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(set_hashes(len(found), hashes, base, live).view(np.int64)), pa.array(count), pa.array(bits, pa.binary()), pa.array(fine, pa.binary()), pa.array(rare, pa.list_(pa.int64()))], ["key", "node", "n", "bits", "fine", "rare"])

    rows = common.materialize(named.mapInArrow(prints, f"key {kind}, node bigint, n bigint, bits binary, fine binary, rare array<bigint>"), "wide-rows")
    classes = common.materialize(rows.groupBy("node").agg(F.min("key").alias("least"), *(F.any_value(c).alias(c) for c in ("n", "bits", "fine", "rare"))), "wide-classes")
    names = common.materialize(rows.select("key", "node"), "wide-names")
    common.discard(rows)
    rough = common.materialize(similar_pairs(classes, similarity), "wide-pairs")
    pairs = common.materialize(finer_links(rough, classes, similarity), "wide-finer")

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in common.slices(batches, "text"):
            hashes, base, live = shingle_sets(found, width)
            sets: list = [[] for _ in found]
            for i, own in zip(live.tolist(), np.split(hashes.view(np.int64), base[1:]), strict=True) if live.size else ():
                sets[i] = own
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "least"), "node")
    texts = named.join(asked.withColumnRenamed("least", "key"), "key").dropDuplicates(["node"]).select("node", "text")
    sets = common.materialize(texts.mapInArrow(shingles, "node bigint, shingles array<bigint>"), "wide-shingles")
    sure = common.materialize(sure_links(pairs, sets, similarity), "wide-sure")
    roots = common.materialize(components(sure), "wide-roots").withColumnRenamed("node", "_node")
    by_root = classes.join(roots, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    groups = by_root.groupBy("root").agg(F.min("least").alias("group"))
    return names.join(by_root.select("node", "root").join(groups, "root").select("node", "group"), "node").select("key", "group")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near-duplicates: of each group the row of the smallest (doc_id, hash of the text) stays, with all columns.

    Null, empty and blank texts are one group. A null id is smaller than any. Of rows with equal id and text that differ in other columns the row of
    the smallest hash of its columns stays; repeated rows leave one. Other columns, whatever their names, go along. An empty table gives no rows.
    """
    keys = [F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")))]
    key = F.struct(*(k.alias(f"c{i}") for i, k in enumerate(keys)))
    found = similar_groups(docs.select(key.alias("key"), "text"), "key", "text", width, similarity)
    stay = found.where("key = group").select(F.col("key").alias("stays")).distinct()
    rows = common.one_of_each(docs, keys)
    return rows.join(stay, F.col("key") == F.col("stays"), "left_semi").select("row.*")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
