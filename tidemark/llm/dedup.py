"""Removal of repeated passages: per-shard suffix arrays and a merge across shards by binary search.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier: in a document before it or before in its own.

1. Each shard (a block of documents) tells buckets the hashes of its anchors. The anchor of
   a window of ``LENGTH`` bytes is its smallest hash of ``GRAM`` bytes, so equal windows have equal anchors. Buckets answer which
   anchors stand in more than one place, and which texts have a whole equal one before them.
2. Each shard builds the suffix array of what lies around shared anchors. Suffixes with a common prefix of ``LENGTH`` bytes
   are one string; its first start in the shard stays a candidate, the others are repeats.
3. Candidates go, cut out by anchor, to buckets. There all shards' window keys are merged into one
   sorted list, and every shard looks its own up by binary search: who isn't the earliest is a repeat. Bytes are compared before it counts.
4. Shards get their repeats back, remove what these cover and give the result.

Inside a shard a passage that many documents share is sent once, so what meets in a bucket
for one passage grows with the shards, not with the documents; and the windows of an anchor that
many shards hold are dealt to all buckets by their own content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .blocks import SENT_DDL, bucket_bits, bucket_cuts, by_bucket, cut_blocks, each_block, frame, open_block, rows, runs, squeeze, stretch, unframe
from .blocks import WHOLE as BLOCK
from .suffix import common_prefixes, suffix_array

LENGTH = 100
GRAM = 32
#: Text bytes of a shard, and of what goes to one bucket.
SHARD_BYTES, BUCKET_BYTES = 2 << 20, 4 << 20
#: An anchor in more shards than these has its windows dealt one by one.
HOT_SHARDS = 16_384
ANCHORS, TEXTS, SEGMENTS, REPEATS = 0, 1, 2, 3
LAST = (1 << 63) - 1
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd base of the window keys, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def gram_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes from each place on."""
    n = len(data)
    padded = data + bytes(GRAM + 8)
    out = np.empty(n, np.uint64)
    views = [np.ndarray(shape=(n,), dtype="<u8", buffer=padded, offset=8 * j, strides=(1,)) for j in range(GRAM // 8)]
    for at in range(0, n, 1 << 15):  # in pieces that stay in the processor's cache
        part = slice(at, at + (1 << 15))
        h = views[0][part] * common.MIX1
        for v in views[1:]:
            h ^= h >> np.uint64(32)
            h += v[part]
            h *= common.MIX2
        h ^= h >> np.uint64(29)
        out[part] = h
    return out


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by running minima from both sides of every ``width``-th place."""
    n = len(values)
    if n < width:
        return values[:0]
    full = np.full(-(-n // width) * width, FULL)
    full[:n] = values
    table = full.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Shard:
    """Documents in order of (id, hash of the text), end to end, and their windows' anchors."""

    def __init__(self, ids: list, found: list[bytes]):
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in found), ">u8").reshape(-1, 2).astype(np.uint64)
        # An id may carry other columns along; it then is a struct that holds doc_id.
        plain = [i["doc_id"] if isinstance(i, dict) else i for i in ids]
        key = np.array([LAST if i is None else i for i in plain], np.int64)
        order = np.lexsort((digest[:, 1], digest[:, 0], key))
        self.order, self.key, self.digest = order, key[order], digest[order]
        texts = [found[i] for i in order]
        self.data = b"".join(texts)
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        # The first of equal texts here.
        by = np.lexsort((np.arange(len(order)), self.digest[:, 1], self.digest[:, 0]))
        same = np.zeros(len(order), bool)
        same[1:] = (self.digest[by[1:]] == self.digest[by[:-1]]).all(axis=1)
        self.first = np.ones(len(order), bool)
        self.first[by[same]] = False
        self.long = self.sizes >= LENGTH

    def anchors(self) -> None:
        """Runs of windows of one anchor, in the first texts: lo, hi (starts, inclusive), at, document; and their hashes."""
        docs = np.flatnonzero(self.first & self.long)
        counts = self.sizes[docs] - LENGTH + 1
        begin = np.cumsum(counts) - counts
        total = int(counts.sum())
        starts = np.arange(total) + np.repeat(self.starts[docs] - begin, counts)
        h = gram_hashes(self.data)
        ordered = (h >> np.uint64(32)) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        least = window_minimum(ordered, LENGTH - GRAM + 1)[starts]
        new = np.ones(total, bool)
        new[1:] = (least[1:] != least[:-1]) | (np.diff(starts) != 1)
        at = np.flatnonzero(new)
        self.lo, self.hi = starts[at], starts[np.append(at[1:], total) - 1] if total else starts[at]
        self.at = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.hash = common.fmix(h[self.at])  # minima are small numbers; mixed, they spread over all buckets
        self.doc = np.repeat(docs, counts)[at]
        by = np.argsort(self.hash)
        s = self.hash[by]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        self.keys = s[new]
        self.place = np.empty(len(s), np.int64)
        self.place[by] = np.cumsum(new) - 1
        self.many = np.bincount(self.place, minlength=len(self.keys)) > 1


def _opened(payload: bytes) -> tuple[pa.Array, Shard]:
    columns, found = open_block(payload)
    ids = columns.column("doc_id").combine_chunks()
    return ids, Shard(ids.to_pylist(), found)


def shared_anchors(blocks: DataFrame, bits: int, hot_shards: int) -> DataFrame:
    """Per shard: which of its anchors, by bucket, stand elsewhere too (1; 2: in more than ``hot_shards`` shards); which of its texts aren't the first of their kind."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, payload in each_block(batches):
            s, out = _opened(payload)[1], []
            s.anchors()
            cuts = bucket_cuts(s.keys, bits)
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = int(cuts[bucket]), int(cuts[bucket + 1])
                out.append((name, ANCHORS, bucket, frame([squeeze(np.diff(s.keys[a:b], prepend=np.uint64(0))), squeeze(s.many[a:b])])))
            docs = np.flatnonzero(s.first & s.long)
            docs = docs[np.argsort(s.digest[docs, 0], kind="stable")]
            cuts = bucket_cuts(s.digest[docs, 0], bits)
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                own = docs[cuts[bucket] : cuts[bucket + 1]]
                out.append((name, TEXTS, bucket, frame([squeeze(s.digest[own, 0]), squeeze(s.digest[own, 1]), squeeze((s.key[own] ^ np.int64(-LAST - 1)).view(np.uint64)), squeeze(own)])))
            yield rows(out)

    def answer(at: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        kind = at[0]
        parts = [[stretch(x) for x in unframe(r[3])] for r in held]
        sizes = [len(p[0]) for p in parts]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        if kind == ANCHORS:
            keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
            by = np.argsort(keys)
            s = keys[by]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            place = np.cumsum(new) - 1
            shards = np.bincount(place)[place]
            yes = np.concatenate([p[1] for p in parts]).astype(np.int64)
            yes[by[shards > 1]] = 1
            yes[by[shards > hot_shards]] = 2
            yield rows([(r[0], kind, at[1], squeeze(yes[a:b])) for r, a, b in zip(held, cuts[:-1], cuts[1:], strict=True)])
            return
        h1, h2, key = (np.concatenate([p[i] for p in parts]) for i in range(3))
        shard = np.repeat([r[0] for r in held], sizes)
        by = np.lexsort((shard, key, h2, h1))
        later = np.zeros(len(by), bool)
        later[1:] = (h1[by[1:]] == h1[by[:-1]]) & (h2[by[1:]] == h2[by[:-1]])
        repeat = np.zeros(len(by), bool)
        repeat[by[later]] = True
        yield rows([(r[0], kind, at[1], squeeze(p[3][repeat[a:b]])) for r, p, a, b in zip(held, parts, cuts[:-1], cuts[1:], strict=True)])

    sent = by_bucket(blocks.mapInArrow(send, SENT_DDL), bits, "kind", "bucket", "block")
    return common.materialize(sent.mapInArrow(lambda b: runs(b, 2, answer, skip=1), SENT_DDL), "shared-anchors")


def together(blocks: DataFrame, messages: DataFrame, out: Callable[[int, pa.Array, Shard, list[tuple]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Each shard with the messages to it: out(name, ids, shard, messages)."""

    def meet(at: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        (whole,) = (r[3] for r in held if r[1] == BLOCK)
        yield from out(at[0], *_opened(whole), [r for r in held if r[1] != BLOCK])

    n = common.partitions(blocks.sparkSession)
    both = blocks.unionByName(messages)
    return both.repartition(n, "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(lambda b: runs(b, 1, meet), schema)


def _spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive rising numbers: first and last of each."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]


def _span_rows(name: int, kind: int, lo: np.ndarray, hi: np.ndarray) -> tuple:
    return (name, kind, 0, frame([squeeze(np.diff(lo, prepend=0)), squeeze(hi - lo)]))


def local_repeats(s: Shard, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Starts, among those in lo..hi (rising, disjoint), whose window has an equal one at an earlier such start."""
    a, b = _merged(lo, hi + LENGTH)
    data = np.frombuffer(s.data, np.uint8)
    sizes = b - a
    base = np.cumsum(sizes) - sizes
    text = np.concatenate([data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]) if len(a) else data[:0]
    counts = hi - lo + 1
    begin = np.cumsum(counts) - counts
    starts = np.arange(int(counts.sum())) + np.repeat(lo - begin, counts)
    region = np.searchsorted(a, lo, side="right") - 1
    inner = starts + np.repeat((base - a)[region], counts)
    order = suffix_array(text)
    together = common_prefixes(text, order) >= LENGTH
    # Only suffixes that are windows count; a chain of long prefixes may lead over others.
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(~together)
    mine = group[inner]
    first = np.full(len(text) + 1, len(text), np.int64)
    np.minimum.at(first, mine, inner)
    return starts[first[mine] != inner]


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals that rise by lo."""
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    new = np.concatenate(([True], lo[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return lo[at], reach[np.append(at[1:], len(lo)) - 1]


def candidates(blocks: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """Per shard: its repeats of itself (REPEATS, TEXTS), and by bucket the windows that may repeat another shard's (SEGMENTS)."""

    def out(name: int, ids: pa.Array, s: Shard, messages: list[tuple]) -> Iterator[pa.RecordBatch]:
        s.anchors()
        shared = np.zeros(len(s.keys), np.int64)
        cuts = bucket_cuts(s.keys, bits)
        again = ~s.first & s.long
        for _, kind, bucket, payload in messages:
            if kind == ANCHORS:
                shared[cuts[bucket] : cuts[bucket + 1]] = stretch(payload).astype(np.int64)
            else:
                again[stretch(payload).astype(np.int64)] = True
        keep = (shared[s.place] > 0) & ~again[s.doc]
        lo, hi, doc, h, hot = (x[keep] for x in (s.lo, s.hi, s.doc, s.hash, shared[s.place] > 1))
        repeats = local_repeats(s, lo, hi)
        yield rows([(name, TEXTS, 0, squeeze(np.flatnonzero(again))), _span_rows(name, REPEATS, *_spans(repeats))])
        # What is left of each run, as runs.
        counts = hi - lo + 1
        begin = np.cumsum(counts) - counts
        starts = np.arange(int(counts.sum())) + np.repeat(lo - begin, counts)
        run = np.repeat(np.arange(len(lo)), counts)
        left = ~np.isin(starts, repeats, assume_unique=True) if len(repeats) else np.ones(len(starts), bool)
        starts, run = starts[left], run[left]
        if not len(starts):
            return
        new = np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(run) != 0) | hot[run[1:]]))
        f = np.flatnonzero(new)
        l = np.append(f[1:], len(starts)) - 1  # noqa: E741
        seg_lo, seg_hi, run = starts[f], starts[l], run[f]
        # Runs go by their anchor; windows of a hot anchor go one by one, by their own content, so none of its buckets grows with it.
        to = h[run]
        single = np.flatnonzero(hot[run])
        if single.size:
            to = to.copy()
            to[single] = window_keys(np.frombuffer(s.data, np.uint8), seg_lo[single])
        by = np.argsort(to, kind="stable")
        seg_lo, seg_hi, run, to = seg_lo[by], seg_hi[by], run[by], to[by]
        cuts = bucket_cuts(to, bits)
        found = []
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(int(cuts[bucket]), int(cuts[bucket + 1]))
            a, b, r = seg_lo[part], seg_hi[part], run[part]
            d = doc[r]
            data = b"".join([s.data[x : y + LENGTH] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            payload = frame([squeeze(a), squeeze(b - a + 1), squeeze((s.key[d] ^ np.int64(-LAST - 1)).view(np.uint64)), squeeze(s.digest[d, 0]), squeeze(s.digest[d, 1]), squeeze(a - s.starts[d]), zstandard.ZstdCompressor(level=1).compress(data)])
            found.append((name, SEGMENTS, bucket, payload))
        yield rows(found)

    return common.materialize(together(blocks, answers, out, SENT_DDL), "suffix-candidates")


def window_keys(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Key of the ``LENGTH`` bytes from each start: a polynomial of the bytes modulo 2**64, mixed."""
    n = len(data)
    power = np.full(n + 1, np.uint64(BASE))
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    back = np.full(n + 1, np.uint64(INVERSE))
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    return common.fmix((sums[starts + LENGTH] - sums[starts]) * back[starts])


def merge_segments(at: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One bucket: which windows of each shard have an equal one in another shard that is earlier."""
    parts = [unframe(r[3]) for r in held]
    lo, count, key, d1, d2, inside = (np.concatenate([stretch(p[i]) for p in parts]) for i in range(6))
    lo, count, inside = lo.astype(np.int64), count.astype(np.int64), inside.astype(np.int64)
    shard = np.repeat(np.arange(len(held)), [len(stretch(p[0])) for p in parts])
    raw = b"".join(zstandard.ZstdDecompressor().decompress(p[6], max_output_size=1 << 31) for p in parts)
    data = np.frombuffer(raw, np.uint8)
    sizes = count + LENGTH - 1
    sizes_before = np.cumsum(sizes) - sizes
    # Windows in the order of what counts as earlier.
    by = np.lexsort((inside, d2, d1, key))
    begin = np.cumsum(count[by]) - count[by]
    segment = np.repeat(by, count[by])
    step = np.arange(len(segment)) - np.repeat(begin, count[by])
    places = sizes_before[segment] + step
    keys = window_keys(data, places)
    merged = np.sort(keys)
    merged = merged[np.concatenate(([True], merged[1:] != merged[:-1]))]
    earliest = np.full(len(merged), len(keys), np.int64)
    found = np.empty(len(keys), np.int64)
    own = shard[segment]
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(len(held) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # each shard looks its windows up
        mine = order[a:b]
        found[mine] = np.searchsorted(merged, keys[mine])
        np.minimum.at(earliest, found[mine], mine)
    rank = np.arange(len(keys))
    late = np.flatnonzero(earliest[found] != rank)
    if not late.size:
        return
    same = np.ones(len(late), bool)
    words = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
    x, y = places[late], places[earliest[found[late]]]
    for j in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        same &= words[x + j] == words[y + j]
    if not same.all():
        # Unlike windows of one key: theirs are told apart by their bytes, in the same order.
        shared = np.isin(found, found[late[~same]])
        seen: set[bytes] = set()
        again = []
        for i in np.flatnonzero(shared).tolist():
            window = raw[places[i] : places[i] + LENGTH]
            if window in seen:
                again.append(i)
            seen.add(window)
        late = np.sort(np.concatenate([late[~shared[late]], np.array(again, np.int64)]))
    starts, own = lo[segment[late]] + step[late], own[late]
    by = np.lexsort((starts, own))
    starts, own = starts[by], own[by]
    cuts = np.searchsorted(own, np.arange(len(held) + 1))
    out = [_span_rows(held[i][0], REPEATS, *_spans(starts[cuts[i] : cuts[i + 1]])) for i in range(len(held)) if cuts[i + 1] > cuts[i]]
    yield rows(out)


def removed_bytes(docs: DataFrame, out: Callable[[pa.Array, list[tuple[bytes, np.ndarray, np.ndarray]]], pa.RecordBatch], schema: str, hot_shards: int = HOT_SHARDS) -> DataFrame:
    """out(ids, [(text, span starts, span ends), ...]) of every shard, spans being what is to go of each document."""
    spark = docs.sparkSession
    common.tune(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = bucket_bits(size, common.partitions(spark), BUCKET_BYTES)
    blocks = cut_blocks(docs, SHARD_BYTES, "shards")
    answers = shared_anchors(blocks, bits, hot_shards)
    found = candidates(blocks, answers, bits)
    common.discard(answers)
    segments = by_bucket(found.where(F.col("kind") == SEGMENTS), bits, "bucket", "block")
    merged = common.materialize(segments.mapInArrow(lambda b: runs(b, 1, merge_segments, skip=2), SENT_DDL), "suffix-repeats")
    messages = found.where(F.col("kind") != SEGMENTS).unionByName(merged)

    def cut(name: int, ids: pa.Array, s: Shard, messages: list[tuple]) -> Iterator[pa.RecordBatch]:
        cover = np.zeros(len(s.data) + 1, np.int32)
        for _, kind, _, payload in messages:
            if kind == TEXTS:
                again = stretch(payload).astype(np.int64)
                cover[s.starts[again]] += 1
                np.subtract.at(cover, s.starts[again] + s.sizes[again], 1)
            else:
                lo, more = (stretch(x).astype(np.int64) for x in unframe(payload))
                lo = np.cumsum(lo)
                np.add.at(cover, lo, 1)
                np.subtract.at(cover, lo + more + LENGTH, 1)
        gone = np.concatenate(([False], np.cumsum(cover[:-1]) > 0))
        # Spans end at document bounds: where a document starts, a new one may start too.
        edge = np.zeros(len(s.data) + 1, bool)
        edge[s.starts] = True
        edge = edge[: len(s.data)]
        now, was = gone[1:], gone[:-1] & ~edge
        first = np.flatnonzero(now & ~was)
        last = np.flatnonzero(now & ~(np.append(now[1:], False) & ~np.append(edge[1:], True))) + 1
        at = np.searchsorted(first, s.starts)
        end = np.searchsorted(first, s.starts + s.sizes)
        result: list = [None] * len(s.order)
        for k, (i, a, b) in enumerate(zip(s.order.tolist(), at.tolist(), end.tolist(), strict=True)):
            base = int(s.starts[k])
            result[i] = (s.data[base : base + int(s.sizes[k])], first[a:b] - base, last[a:b] - base)
        yield out(ids, result)

    return together(blocks, messages, cut, schema)


def _kept(text: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    if not len(lo):
        return text
    return b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot_shards: int = HOT_SHARDS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept, the bytes that stay).

    spans: [start, end) byte offsets of the removed runs.

    Null texts are empty. Texts below 100 bytes lose nothing and take nothing. Documents are in order of their id, null last;
    rows with equal ids in order of their texts' hashes, and of repeated rows one stays and the others lose all.
    An empty table gives no rows. Other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def out(ids: pa.Array, found: list) -> pa.RecordBatch:
        kept = [_kept(*x) for x in found]
        columns = [
            ids,
            pa.array([len(t) for t, _, _ in found], pa.int64()),
            pa.array([len(t) - len(k) for (t, _, _), k in zip(found, kept, strict=True)], pa.int64()),
            pa.array([len(lo) for _, lo, _ in found], pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            pa.array([np.stack([lo, hi], axis=1).tolist() for _, lo, hi in found], pa.list_(pa.list_(pa.int64()))),
        ]
        if with_text:
            columns.append(pa.array(kept, pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(columns)])

    return removed_bytes(d, out, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>" + ", kept binary" * with_text, hot_shards)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated passages cut out, all columns kept, n_chars counted anew if there.

    A document that loses every byte goes. A character of which only some bytes repeat goes whole.

    Null and empty texts stay, as empty. Documents are in order of their id, null last, and rows of equal ids in order of
    their texts' hashes; of repeated rows one stays. Other columns, whatever their names, go along. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c != "text"]
    d = docs.select(F.struct(*others).alias("doc_id"), "text")

    def out(ids: pa.Array, found: list) -> pa.RecordBatch:
        kept = [_kept(*x) for x in found]
        stay = pa.array([bool(k) or not len(lo) for k, (_, lo, _) in zip(kept, found, strict=True)])
        text = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.RecordBatch.from_arrays([ids, text], ["doc_id", "text"]).filter(stay)

    cut = removed_bytes(d, out, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")
    cut = cut.select("doc_id.*", "text")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(common.table(spark, sf_dir, "documents")).drop("spans")
