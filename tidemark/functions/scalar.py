"""Column expressions: portable hashing, bit counting, record sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_hash(key: Column, seed: Column | int) -> Column:
    """32-bit hash of a key under a seed: the first 8 hex digits of md5('seed:key')."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), key)), 1, 8), 16, 10).cast("bigint")


def trailing_zeros(value: Column, width: int) -> Column:
    """Trailing zero bits of a non-negative integer, ``width`` for 0."""
    lowest = value.bitwiseAND(-value)
    return F.when(value == 0, F.lit(width)).otherwise(F.bit_count(lowest - 1)).cast("int")


def ascii_binary(text: Column) -> Column:
    """Each character's code as 8 binary digits, joined."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1), lambda c: F.lpad(F.bin(F.ascii(c)), 8, "0")), "")


def hamming(left: list[Column], right: list[Column]) -> Column:
    """Differing bits of two values, each a list of 64-bit words."""
    total = F.lit(0)
    for a, b in zip(left, right, strict=True):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total.cast("int")


def value_crc(value: Column) -> Column:
    """CRC-32 of a value's bytes; null values count as empty."""
    return F.crc32(F.coalesce(value.cast("binary"), F.lit("").cast("binary")))


def record_bytes(key: Column, value: Column) -> Column:
    """Bytes of a framed record: crc 4, time 8, tombstone 1, two sizes 8 each, key, value."""
    return (F.lit(29) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("bigint")
