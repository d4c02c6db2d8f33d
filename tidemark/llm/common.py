"""What the operators share: shared storage, ordered numbering, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+`` is a word in every operator that counts words.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that end a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, by Spark's reader, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds (long texts) and drop an action's shuffle files once it ends."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new Parquet table in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a reread and no recomputation, and
    fixes what depends on task order (row indexes) for every later reader.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made, when nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.rstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered(df: DataFrame, keys: list[str], name: str, weights: dict[str, str] | None = None) -> DataFrame:
    """``df`` sorted by ``keys`` with ``_index``, its rank from 0, written to the shared folder.

    weights: new column -> numeric column; the new column is the sum of the other over
    all earlier rows. Range partitions hold runs of the order; a partition's base is
    the sum over those before it, so the driver sees one row per partition.
    """
    spark = df.sparkSession
    weights = weights or {}
    part = F.shiftright("_m", 33)
    placed = materialize(
        df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()),
        name,
    )
    sums = [F.count(F.lit(1)).alias("_n"), *(F.sum(F.coalesce(F.col(w), F.lit(0))).alias(c) for c, w in weights.items())]
    rows = sorted(placed.groupBy(part.alias("_p")).agg(*sums).collect(), key=lambda r: r["_p"])
    base: dict[str, dict[int, int]] = {c: {} for c in ["_n", *weights]}
    for c, to in base.items():
        total = 0
        for r in rows:
            to[r["_p"]] = total
            total += r[c] or 0
    size = (rows[-1]["_p"] + 1) if rows else 1

    def at(c: str):
        return F.element_at(F.lit([base[c].get(p, 0) for p in range(size)]).cast("array<bigint>"), (part + 1).cast("int"))

    out = placed.withColumn("_index", at("_n") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    if weights:
        from pyspark.sql import Window

        before = Window.partitionBy(F.shiftright("_m", 33)).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
        for c, w in weights.items():
            out = out.withColumn(c, at(c) + F.coalesce(F.sum(F.coalesce(F.col(w), F.lit(0))).over(before), F.lit(0)))
    return out.drop("_m")


def one_of_each(docs: DataFrame, keys: list[F.Column]) -> DataFrame:
    """key (a struct of c0, c1, ...), row (a struct of all columns, so no names clash): one row for each key, that of the smallest hash of its columns.

    Columns of maps, which can't be hashed, don't count for the hash.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    key = F.struct(*(k.alias(f"c{i}") for i, k in enumerate(keys)))
    named = docs.select(key.alias("key"), F.xxhash64(*plain).alias("order"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return named.groupBy("key").agg(F.min_by("row", "order").alias("row"))


#: Called when a worker turns to other texts: what an operator kept in this process for its next task.
HELD: list = []


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut where their texts exceed ``most`` bytes: bounds the arrays that numpy works on."""
    for release in HELD:
        release()
    for batch in batches:
        if not batch.num_rows:
            continue
        found = texts(batch.column(batch.schema.get_field_index(column)))
        at = size = 0
        for i, x in enumerate(found):
            if size and size + len(x) > most:
                yield batch.slice(at, i - at), found[at:i]
                at, size = i, 0
            size += len(x) + 1
        yield batch.slice(at), found[at:]


def fmix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (murmur's finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h *= MIX1
    h ^= h >> np.uint64(33)
    h *= MIX2
    h ^= h >> np.uint64(33)
    return h


def hash_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span data[start:end], in 8-byte steps over all spans at once."""
    padded = data + bytes(8)
    words = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = (ends - starts).astype(np.int64)
    h = left.astype(np.uint64) * GOLDEN
    live, at = np.arange(len(starts)), starts.astype(np.int64)
    while live.size:
        take = np.minimum(left, 8).astype(np.uint64)
        mask = np.where(take == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (take * np.uint64(8))) - np.uint64(1))
        h[live] = fmix(h[live] ^ (words[at] & mask)) * GOLDEN
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return fmix(h)


def words_of(found: list[bytes], plain: np.ndarray = LOWER, space: np.ndarray = SPACE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts: (joined mapped bytes, starts, ends, number of words of each text).

    plain maps bytes (default: lower-case A-Z); space tells which mapped bytes end a word.
    """
    data = b" ".join(found) + b" "
    data = data.translate(plain.tobytes())
    a = np.frombuffer(data, np.uint8)
    gap = np.empty(len(a) + 1, dtype=bool)
    gap[0] = True
    gap[1:] = space[a]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[0::2], edges[1::2]
    size = np.fromiter(map(len, found), np.int64, len(found))
    bounds = np.cumsum(size + 1)
    counts = np.diff(np.searchsorted(starts, bounds, side="left"), prepend=0)
    return data, starts, ends, counts


def crc_share(column: str, modulus: int) -> F.Column:
    """crc32 of the integer's decimal text, modulo ``modulus``: the folds of the learning operators."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def range_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 rising values that cut the column into n ranges of about equal counts.

    Reads that column only. Nulls are left out; they belong to the first range.
    """
    at = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(column, at, 20 * n)).head()[0] if at else None
    return sorted(set(found or []))


def range_of(values: pa.Array, bounds: list[int]) -> np.ndarray:
    """The range of each value, nulls in range 0; a value equal to a bound goes right of it."""
    v = values.to_numpy(zero_copy_only=False)
    if v.dtype.kind == "f":  # with nulls
        return np.where(np.isnan(v), 0, np.searchsorted(bounds, np.nan_to_num(v), side="right")).astype(np.int32)
    return np.searchsorted(bounds, v, side="right").astype(np.int32)
