"""Token files: one wavelet matrix per shard of documents.

A shard's ids, all documents in order, are split into bit-planes from the highest bit
down; below each plane the ids are parted stably by that bit. With a count of ones at
every block a plane answers rank and select, and from these follow the id at a place,
the count of an id in a range and the place of its k-th occurrence, without decoding.

File format (``.tmw``, one file a shard), little-endian:
magic ``TMW3``; u32 bits, u64 tokens, u64 documents; u64 zeros of each plane; u32 sizes of the sections that follow:
the documents, then for each plane its counts and its chunks of ``CHUNK`` bytes. Each section is a zstd frame by itself, so a query
opens the sections it needs. Documents: i64 ids (0 for null), a bit per document that tells whether its id is known (first bit highest), u32 lengths.
Counts: u32 ones before each block of 512 bits. Chunks: packed bits (first bit highest), blocks filled up with zeros.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

BLOCK = 512
#: Bytes of a plane that are compressed together.
CHUNK = 1 << 16
MAGIC = b"TMW3"
HEAD = "<4sIQQ"
ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.uint8)


class Plane:
    """Bits, and the ones before each block of them; from memory, or chunk by chunk as they are asked for."""

    def __init__(self, bits: np.ndarray | None = None, ranks: np.ndarray | None = None, chunk: Callable[[int], np.ndarray] | None = None, load_ranks: Callable[[], np.ndarray] | None = None, chunks: int = 0):
        self._bits, self._ranks, self._chunk, self._load_ranks, self._chunks = bits, ranks, chunk, load_ranks, chunks
        self._open: dict[int, np.ndarray] = {}

    @property
    def ranks(self) -> np.ndarray:
        if self._ranks is None:
            self._ranks = self._load_ranks()
        return self._ranks

    def bits(self) -> np.ndarray:
        """All bytes."""
        if self._bits is None:
            return np.concatenate([self._chunk(i) for i in range(self._chunks)] or [np.zeros(0, np.uint8)])
        return self._bits

    def block(self, i: int) -> np.ndarray:
        """The bytes of a block."""
        at, size = i * BLOCK // 8, BLOCK // 8
        if self._bits is not None:
            return self._bits[at : at + size]
        where = at // CHUNK
        if where not in self._open:
            self._open[where] = self._chunk(where)
        return self._open[where][at % CHUNK : at % CHUNK + size]


class WaveletMatrix:
    """Succinct sequence of integers below 2**bits."""

    def __init__(self, n: int, bits: int, zeros: np.ndarray, planes: list[Plane]):
        self.n, self.bits, self.zeros, self.planes = n, bits, zeros, planes

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes = np.zeros(bits, np.uint64), []
        for level in range(bits):
            one = (a >> a.dtype.type(bits - 1 - level)) & a.dtype.type(1) != 0
            packed = np.packbits(one)
            packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
            before = np.cumsum(ONES[packed].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32), dtype=np.uint32)
            planes.append(Plane(packed, np.concatenate([np.zeros(1, np.uint32), before])))
            a = np.concatenate([np.compress(~one, a), np.compress(one, a)])
            zeros[level] = len(a) - int(planes[-1].ranks[-1])
        return cls(len(ids), bits, zeros, planes)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level].block(i // BLOCK)[i % BLOCK >> 3]) >> (7 - (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, inside = divmod(i, BLOCK)
        whole = int(self.planes[level].ranks[block])
        if not inside:
            return whole
        data = self.planes[level].block(block)
        whole += int(ONES[data[: inside >> 3]].sum())
        return whole + (int(data[inside >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else whole

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a plane."""
        ranks = self.planes[level].ranks.astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        found = np.unpackbits(self.planes[level].block(block)) == bit
        return block * BLOCK + int(np.flatnonzero(found)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _span(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a value among the first ``end`` lie below the last plane."""
        lo, hi = 0, end
        if value >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if value >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, end: int) -> int:
        """Occurrences of a value among the first ``end`` ids."""
        lo, hi = self._span(value, end)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a value."""
        lo, hi = self._span(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level].bits(), count=self.n).view(bool)
            zeros, up = int(self.zeros[level]), np.empty(self.n, kind)
            up[np.flatnonzero(~one)] = a[:zeros]
            up[np.flatnonzero(one)] = a[zeros:] | kind(1 << (self.bits - 1 - level))
            a = up
        return a


def write_shard(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """A file's bytes."""
    matrix = WaveletMatrix.build(ids, bits)
    sections = [doc_ids.astype("<i8").tobytes() + np.packbits(known).tobytes() + lengths.astype("<u4").tobytes()]
    for plane in matrix.planes:
        data = plane.bits().tobytes()
        sections += [plane.ranks.astype("<u4").tobytes(), *(data[i : i + CHUNK] for i in range(0, len(data), CHUNK))]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    packed = [squeeze(x) for x in sections]
    head = struct.pack(HEAD, MAGIC, bits, len(ids), len(doc_ids)) + matrix.zeros.astype("<u8").tobytes()
    return b"".join([head, np.array([len(x) for x in packed], "<u4").tobytes(), *packed])


class TokenFile:
    """A file opened for queries: ``read(offset, size)`` gives its bytes, of which only the sections in use are asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        size = struct.calcsize(HEAD)
        magic, bits, self.n, self.docs = struct.unpack(HEAD, read(0, size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        chunks = -(-(-(-self.n // BLOCK) * BLOCK // 8) // CHUNK)
        sections = 1 + bits * (1 + chunks)
        head = read(size, 8 * bits + 4 * sections)
        sizes = np.frombuffer(head, "<u4", sections, 8 * bits).astype(np.int64)
        starts = size + len(head) + np.cumsum(sizes) - sizes

        def section(i: int, kind: str) -> np.ndarray:
            return np.frombuffer(zstandard.ZstdDecompressor().decompress(read(int(starts[i]), int(sizes[i]))), kind)

        self._section = section
        planes = [Plane(chunk=lambda i, p=p: section(p + 1 + i, np.uint8), load_ranks=lambda p=p: section(p, "<u4"), chunks=chunks) for p in range(1, sections, 1 + chunks)]
        self.matrix = WaveletMatrix(self.n, bits, np.frombuffer(head, "<u8", bits), planes)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, which of them are known, lengths)."""
        data = self._section(0, np.uint8).tobytes()
        at = 8 * self.docs
        known = np.unpackbits(np.frombuffer(data, np.uint8, -(-self.docs // 8), at), count=self.docs).view(bool)
        return np.frombuffer(data, "<i8", self.docs), known, np.frombuffer(data, "<u4", self.docs, at + -(-self.docs // 8))


def from_bytes(blob: bytes) -> TokenFile:
    return TokenFile(lambda at, size: blob[at : at + size])


def open_file(path: str) -> TokenFile:
    """A file of any store that pyarrow reaches; reads the sections that queries need."""
    store, place = pa.fs.FileSystem.from_uri(path)
    source = store.open_input_file(place)
    return TokenFile(lambda at, size: source.read_at(size, at))


def write_token_files(docs: DataFrame, folder: str | None = None, end_id: int = 2, bits: int = 16, shard_tokens: int = 1 << 22, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode documents, sort them by id and write one file per shard; returns the folder.

    The folder (by default a new one in the shared folder) holds the ``.tmw`` files and ``index``, a table of part,
    shard (shards in document order), n_docs, n_tokens and file. A shard closes at the first document that brings it to
    ``shard_tokens`` ids, so a document of any length is whole in one shard. A task that runs again writes the same files anew, each by one rename.

    A null text is empty (its end id alone). Rows with equal ids stand side by side, by ids_crc32 of their tokens.
    Rows with a null id come first and keep the null. An empty table gives an empty index and no file. Other columns are ignored.
    """
    folder = folder or f"{common.shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    spark = docs.sparkSession
    common.tune(spark)
    parts = common.partitions(spark)
    bounds = common.range_bounds(docs, id_col, parts)
    end = int(end_id).to_bytes(4, "little")
    narrow = np.dtype("<u2" if bits <= 16 else "<u4")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [np.frombuffer(x + end, "<u4") for x in enc.encode([x or "" for x in batch.column(1).to_pylist()])]
            if any(len(x) and int(x.max()) >> bits for x in ids):
                raise ValueError(f"an id needs more than {bits} bits")
            where = common.range_of(batch.column(0).fill_null(0), bounds)
            where[batch.column(0).is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), batch.column(0).cast(pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([x.astype(narrow).tobytes() for x in ids], pa.binary())],
                ["part", "doc_id", "crc", "ids"],
            )

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size = shard = 0
        part = None

        def close() -> pa.RecordBatch:
            doc_ids, found = np.array([d or 0 for d, _ in held], np.int64), [x for _, x in held]
            known = np.array([d is not None for d, _ in held], bool)
            lengths = np.array([len(x) // narrow.itemsize for x in found], np.uint32)
            blob = write_shard(doc_ids, known, lengths, np.frombuffer(b"".join(found), narrow), bits)
            store, place = pa.fs.FileSystem.from_uri(folder)
            name = f"{part:06d}-{shard:06d}.tmw"
            store.create_dir(place, recursive=True)
            mine = f"{place}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(mine) as out:
                out.write(blob)
            store.move(mine, f"{place}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([name])], ["part", "shard", "n_docs", "n_tokens", "file"])

        for batch in batches:
            for p, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held and (p != part or size >= shard_tokens * narrow.itemsize):
                    yield close()
                    held, size, shard = [], 0, shard + 1 if p == part else 0
                part = p
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield close()

    encoded = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "part int, doc_id bigint, crc bigint, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "crc", "ids")
    dealt.mapInArrow(build, "part int, shard bigint, n_docs bigint, n_tokens bigint, file string").write.parquet(f"{folder}/index")
    return folder


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files of a folder: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    names = ["file", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"][: 5 + with_ids]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                opened = from_bytes(blob.as_py())
                doc_ids, known, lengths = opened.documents()
                data = opened.matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                cuts = list(zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist(), strict=True))
                cols = [pa.array([name] * len(doc_ids)), pa.array(doc_ids, mask=~known), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(data[a:b]) for a, b in cuts], pa.int64())]
                if with_ids:
                    cols.append(pa.array([data[a:b] for a, b in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    shards = spark.read.schema("part int, shard bigint, n_docs bigint, n_tokens bigint, file string").parquet(f"{folder}/index")
    # Bases: one number per part on the driver, a running sum of shards within it.
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = [], 0
    for p in range(max(sums, default=0) + 1):
        base.append(total)
        total += sums.get(p, 0)
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("file", (F.element_at(F.lit(base).cast("array<bigint>"), F.col("part") + 1) + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("base"))
    schema = "file string, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tmw").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")
    found = files.mapInArrow(read, schema).join(bases, "file")
    return found.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), *names[3:])


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(common.table(spark, sf_dir, "documents")))
