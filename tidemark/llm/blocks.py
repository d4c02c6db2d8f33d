"""Blocks of documents, written once for several passes over them, and compact messages between them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: A message: the block it is from or for, what it is, the bucket it goes to, its content.
SENT = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
SENT_DDL = "block bigint, kind int, bucket int, payload binary"


def squeeze(a: np.ndarray) -> bytes:
    """Compress non-negative integers, plane by plane of their bytes."""
    a = a.astype("<u8")
    planes = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    flat = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return len(a).to_bytes(6, "little") + bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(flat)


def stretch(data: bytes) -> np.ndarray:
    n, planes = int.from_bytes(data[:6], "little"), data[6]
    out = np.zeros((n, 8), np.uint8)
    if n and planes:
        out[:, :planes] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[7:], max_output_size=n * planes), np.uint8).reshape(planes, n).T
    return out.view("<u8").ravel()


def frame(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(6, "little") + x for x in parts)


def unframe(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 6], "little")
        out.append(data[at + 6 : at + 6 + n])
        at += 6 + n
    return out


def ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, rising, and the place of each value among them."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(len(s), np.int64)
    rank[order] = np.cumsum(new) - 1
    return s[new], rank


def rows(found: list[tuple], schema: pa.Schema = SENT) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: What a row of a table of blocks is, for those who mix it with messages of kinds from 0 on.
WHOLE = 99


def cut_blocks(docs: DataFrame, most: int, name: str) -> DataFrame:
    """``docs`` (text last) as blocks of up to ``most`` text bytes, one row each, written to the shared folder.

    The input is read once. Every later pass reads the written blocks, so it sees the same ones under the same
    names, whatever order the input's rows come in.
    """
    kinds = [to_arrow_type(f.dataType) for f in docs.schema.fields[:-1]]
    *names, text = docs.columns

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for batch, found in common.slices(batches, text, most):
            sink = pa.BufferOutputStream()
            head = pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(batch.columns[:-1], kinds, strict=True)], names)
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_batch(head)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            payload = frame([sink.getvalue().to_pybytes(), squeeze(sizes), zstandard.ZstdCompressor(level=1).compress(b"".join(found))])
            yield rows([((part << 32) + count, WHOLE, 0, payload)])
            count += 1

    return common.materialize(docs.mapInArrow(cut, SENT_DDL), name)


def open_block(payload: bytes) -> tuple[pa.Table, list[bytes]]:
    """(the other columns, the texts) of a block."""
    head, sizes, data = unframe(payload)
    with pa.ipc.open_stream(pa.BufferReader(head)) as r:
        columns = r.read_all()
    ends = np.cumsum(stretch(sizes).astype(np.int64)).tolist()
    data = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, ends[-1] if ends else 1))
    return columns, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def each_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(name, payload) of the rows of a table of blocks."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)


def bucket_bits(text_bytes: int, at_least: int, most: int) -> int:
    """Bits that name so many buckets that ``most`` text bytes' share goes to one, and ``at_least`` in all."""
    return max(0, (max(-(-text_bytes // most), at_least) - 1).bit_length())


def by_bucket(sent: DataFrame, bits: int, *order: str) -> DataFrame:
    """Messages dealt to partitions by runs of buckets; hashes fill buckets alike, so partitions too."""
    n = common.partitions(sent.sparkSession)
    return sent.repartitionById(n, F.shiftright(F.col("bucket").cast("long") * n, bits).cast("int")).sortWithinPartitions(*order)


def runs(batches: Iterable[pa.RecordBatch], keys: int, close: Callable[[tuple, list[tuple]], Iterable[pa.RecordBatch]], skip: int = 0) -> Iterator[pa.RecordBatch]:
    """Gather sorted rows by equal columns skip .. skip + keys, across batches, and pass each run to ``close``."""
    held: list[tuple] = []
    at: tuple | None = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = row[skip : skip + keys]
            if held and key != at:
                yield from close(at, held)
                held = []
            at = key
            held.append(row)
    if held:
        yield from close(at, held)


def bucket_cuts(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of the highest ``bits`` bits starts in rising 64-bit keys, and the end."""
    if not bits:
        return np.array([0, len(sorted_keys)])
    return np.searchsorted(sorted_keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
