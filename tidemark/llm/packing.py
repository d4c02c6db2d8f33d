"""Packing by power-of-two decomposition: every piece is a sequence of its own.

A document of n tokens falls into n // 1024 pieces of 1024 and one piece for each bit
set in the rest, largest first. Sequences of equal length form a bucket, so a batch
needs no padding and no sequence holds two documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder


def piece_lengths(n: int, longest: int = 1024) -> list[int]:
    """Lengths of a document's pieces, ``longest`` being a power of two."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, longest: int = 1024, end_id: int | None = 0, path: str | None = None, with_ids: bool = False, cached: int = 1_200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    sequence_id numbers the sequences from 0 by falling length, so buckets of equal
    lengths are runs of it; offset is always 0. ids: little-endian unsigned 32-bit ids. cached: words that a worker keeps the ids of.

    A null text is empty and packs its end id alone. Empty, long, null-id and repeated
    rows are packed like any other; repeated rows give equal pieces with different sequence_ids. Without end
    id an empty document has no piece. An empty table gives no rows. Other columns are ignored.
    """
    common.tune(docs.sparkSession)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, cached)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            who: list[int] = []
            found = batch.column(1).to_pylist()
            for k, ids in enumerate(enc.encode([x or "" for x in found])):
                ids += end
                n, at = len(ids) // 4, 0
                for length in piece_lengths(n, longest):
                    part = ids[4 * at : 4 * (at + length)]
                    who.append(k)
                    for col, v in zip(rows, (at, length, zlib.crc32(part), n, part), strict=True):
                        col.append(v)
                    at += length
            arrays = [batch.column(0).take(pa.array(who, pa.int64())), *(pa.array(c, pa.int64()) for c in rows[:4])]
            if with_ids:
                arrays.append(pa.array(rows[4], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    pieces = common.materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema).withColumn("_short", -F.col("length")), "pieces")
    placed = common.ordered(pieces, ["_short", "doc_id", "start", "ids_crc32"], "sequences")
    return placed.select(*names[:5], F.col("_index").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *names[5:])


def op2_pack(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
