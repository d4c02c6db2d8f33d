"""Lempel-Ziv phrase fingerprints: what a text's parse adds to its dictionary, as a minimum-hash sketch.

The parse takes the shortest phrase not yet in the dictionary, over UTF-8 bytes, and
adds it. Texts that compress with each other share phrases, so the resemblance of their phrase
sets, estimated from the 64 smallest phrase hashes of each, is near to what a
compressor would say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hashes in a fingerprint.
KEEP = 64


def parse(data: bytes, seen: set[bytes], start: int, stop: int) -> tuple[list[int], int]:
    """Phrases of data from ``start`` on, as their ends; adds them to ``seen``.

    Ends before the first phrase that would pass ``stop``, and returns where that one
    starts. The dictionary holds every prefix of its phrases, so the search begins at the
    last phrase's length and goes up or down from there.
    """
    ends: list[int] = []
    k = 1
    while start < stop:
        end = start + k
        if end > stop:
            end = stop
        if data[start:end] in seen:
            end += 1
            while end <= stop and data[start:end] in seen:
                end += 1
            if end > stop:
                break
        else:
            end -= 1
            while end > start and data[start:end] not in seen:
                end -= 1
            end += 1
        seen.add(data[start:end])
        ends.append(end)
        k = end - start
        start = end
    return ends, start


def _smallest(hashes: np.ndarray) -> np.ndarray:
    """The ``KEEP`` smallest distinct hashes, rising."""
    return _distinct(hashes)[:KEEP]


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate(([True], a[1:] != a[:-1]))] if len(a) else a


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated resemblance of the phrase sets: shared among the smallest hashes of the union. 1 for two empty sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    first = np.concatenate(([True], both[1:] != both[:-1]))
    top = both[first][:KEEP][-1]
    inside = both <= top
    shared = int(inside.sum()) - int(first[inside].sum())
    return shared / int(first[inside].sum())


def sketch(text: str) -> np.ndarray:
    """The fingerprint of one text, as hashes."""
    return sketches([(text, None)])[0][0]


def sketches(pairs: list[tuple[str, str | None]]) -> list[tuple[np.ndarray, np.ndarray | None, bytes]]:
    """For each (text, next text): the text's sketch, the edited text's, the edited text in UTF-8.

    The edited text is the text with its last third of code points replaced by the first as
    many of the next text. Its parse is the text's own up to the edit, so that part runs once.
    """
    buffers: list[bytes] = []
    spans: list[tuple[np.ndarray, np.ndarray]] = []
    parts: list[tuple[int, int, int]] = []  # phrases before the edit, after it, of the edited tail
    edits: list[bytes] = []
    offset = 0

    def put(data: bytes, start: int, ends: list[int]) -> int:
        nonlocal offset
        e = np.array(ends, np.int64)
        spans.append((offset + np.concatenate(([start], e[:-1])) if len(e) else e, offset + e))
        return len(e)

    for text, after in pairs:
        data = text.encode()
        seen: set[bytes] = set()
        third = len(text) // 3
        cut = len(text[: len(text) - third].encode()) if third else len(data)
        ends, at = parse(data, seen, 0, cut)
        buffers.append(data)
        head = put(data, 0, ends)
        ends, _ = parse(data, seen, at, len(data))
        tail = put(data, at, ends)
        offset += len(data)
        changed = 0
        if after is not None:
            edited = data[:cut] + after[:third].encode()
            edits.append(edited)
            start = at
            for end in ends:
                seen.discard(data[start:end])
                start = end
            ends, _ = parse(edited, seen, at, len(edited))
            buffers.append(edited)
            changed = put(edited, at, ends)
            offset += len(edited)
        else:
            edits.append(b"")
        parts.append((head, tail, changed))
    if not pairs:
        return []
    hashes = (common.hash_spans(b"".join(buffers), np.concatenate([s for s, _ in spans]), np.concatenate([e for _, e in spans])) >> np.uint64(32)).astype(np.uint32)
    out, at = [], 0
    for (head, tail, changed), edited, (_, after) in zip(parts, edits, pairs, strict=True):
        own = hashes[at : at + head + tail]
        other = np.concatenate([hashes[at : at + head], hashes[at + head + tail : at + head + tail + changed]]) if after is not None else None
        out.append((_smallest(own), _smallest(other) if other is not None else None, edited))
        at += head + tail + changed
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's next one follows it in descending id; the first follows the last. Documents are dealt out by ranges of the id; the
    first document of each range goes to the range before it as well, so neighbours always meet.

    fingerprint: 8 hex digits for each hash, rising; empty for the empty text. Null texts
    are empty. Rows with equal ids stand in the order of their texts' hashes; null ids come last. A
    document alone is its own next one. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.tune(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bounds = common.range_bounds(d, "doc_id", common.partitions(spark))

    def tag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(common.range_of(b.column(0), bounds)), b.column(0)], ["part", "doc_id"])

    heads = {r["part"]: r["head"] for r in d.select("doc_id").mapInArrow(tag, f"part int, doc_id {kind}").groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    falling = sorted(heads, reverse=True)
    before = dict(zip(falling, [falling[-1], *falling[:-1]], strict=True)) if falling else {}

    @F.arrow_udf("array<int>")
    def targets(ids: pa.Array) -> pa.Array:
        where = common.range_of(ids, bounds).tolist()
        return pa.array([[2 * p, 2 * before[p] + 1] if x == heads[p] else [2 * p] for p, x in zip(where, ids.to_pylist(), strict=True)], pa.list_(pa.int32()))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            rows = waiting + list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [x or "" for x in batch.column(2).to_pylist()], strict=True))
            waiting = rows[-1:]
            # A row is done once its next one is there; a copied head only serves the row before it.
            done = [(i, rows[i]) for i in range(len(rows) - 1) if not rows[i][0] & 1]
            found = sketches([(r[2], rows[i + 1][2]) for i, r in done])
            own = {i: s for (i, _), (s, _, _) in zip(done, found, strict=True)}
            missing = [i + 1 for i, _ in done if i + 1 not in own]
            own |= {i: s[0] for i, s in zip(missing, sketches([(rows[i][2], None) for i in missing]), strict=True)}
            text = lambda s: s.astype(">u4").tobytes().hex()
            cols = list(zip(*((r[1], len(r[2]), hashlib.sha256(e).hexdigest(), text(s), text(t), likeness(s, t), likeness(s, own[i + 1])) for (i, r), (s, t, e) in zip(done, found, strict=True)), strict=True)) or [()] * 7
            kinds = [batch.schema.field(1).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    dealt = (
        d.withColumn("target", F.explode(targets("doc_id")))
        .repartitionById(len(bounds) + 1, F.shiftright("target", 1))
        .withColumn("tie", F.xxhash64("text"))
        .sortWithinPartitions("target", F.desc_nulls_last("doc_id"), "tie")
        .select("target", "doc_id", "text")
    )
    return dealt.mapInArrow(work, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_lz_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
