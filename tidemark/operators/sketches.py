"""Bloom, Count-Min and HyperLogLog as relations over a portable hash: mergeable, repeatable, exact to compare."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import portable_hash, trailing_zeros
from ..sources.oplog import SQL
from .lsm import _RUNS


def bloom_size(n: Column, rate: float) -> tuple[Column, Column]:
    """(bits, hashes) of a Bloom filter for n keys at a false-positive rate."""
    bits = F.ceil(n * abs(math.log(rate)) / F.lit(math.log(2) ** 2))
    return bits.cast("bigint"), F.ceil(bits / n * math.log(2)).cast("bigint")


def bloom_sizing(run: DataFrame, rate: float) -> DataFrame:
    """Per run: level, gen, n, bits, hashes."""
    bits, hashes = bloom_size(F.col("n"), rate)
    return run.groupBy("level", "gen").agg(F.count(F.lit(1)).alias("n")).select("level", "gen", "n", bits.alias("bits"), hashes.alias("hashes"))


def positions(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """key, bit: the places a key sets."""
    return keys.select("key", F.explode(F.array(*(F.pmod(portable_hash(F.col("key"), i), F.lit(bits)) for i in range(hashes)))).alias("bit"))


def bloom_bits(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The filter as the set of its bits."""
    return positions(keys, bits, hashes).select("bit").distinct()


def bloom_semi_join(probe: DataFrame, keys: DataFrame, rate: float) -> DataFrame:
    """Rows of probe whose key is among keys: filter first, exact check of what passes.

    A plain ``left_semi`` join with Spark's own runtime filter gives the same rows; this one works on a filter that may be saved.
    """
    n = max(1, keys.select("key").distinct().count())
    bits = math.ceil(n * abs(math.log(rate)) / math.log(2) ** 2)
    hashes = math.ceil(bits / n * math.log(2))
    own = probe.select("key").distinct()
    passed = positions(own, bits, hashes).distinct().join(bloom_bits(keys, bits, hashes), "bit").groupBy("key").agg(F.count(F.lit(1)).alias("hits"))
    distinct = positions(own, bits, hashes).groupBy("key").agg(F.count_distinct("bit").alias("wanted"))
    maybe = passed.join(distinct, "key").where("hits = wanted").select("key")
    sure = maybe.join(keys.select("key").distinct(), "key", "left_semi")
    return probe.join(sure, "key", "left_semi")


def cms_size(epsilon: float, delta: float) -> tuple[int, int]:
    """(buckets, rows) of a Count-Min sketch."""
    return math.ceil(math.e / epsilon), math.ceil(math.log(math.e / delta))


def cms_matrix(keys: DataFrame, epsilon: float, delta: float, by: list[str] | None = None) -> DataFrame:
    """Non-empty cells: by..., row, bucket, count. Keys are counted first, so each distinct key is hashed once."""
    by = by or []
    width, depth = cms_size(epsilon, delta)
    counted = keys.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"))
    cells = F.posexplode(F.array(*(F.pmod(portable_hash(F.col("key"), i), F.lit(width)) for i in range(depth)))).alias("row", "bucket")
    return counted.select(*by, "n", cells).groupBy(*by, "row", "bucket").agg(F.sum("n").alias("count"))


def cms_frequency(keys: DataFrame, asked: DataFrame, epsilon: float, delta: float, by: list[str] | None = None) -> DataFrame:
    """For each asked key (of each group): by..., key, estimate, never below the truth."""
    by = by or []
    width, depth = cms_size(epsilon, delta)
    cells = asked.select(*by, "key", F.posexplode(F.array(*(F.pmod(portable_hash(F.col("key"), i), F.lit(width)) for i in range(depth)))).alias("row", "bucket"))
    matrix = cms_matrix(keys, epsilon, delta, by)
    return cells.join(matrix, [*by, "row", "bucket"], "left").groupBy(*by, "key").agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


def cms_bounds(keys: DataFrame, epsilon: float, delta: float) -> DataFrame:
    """key, exact, estimate, within (estimate at most exact + epsilon * total)."""
    exact = keys.groupBy("key").agg(F.count(F.lit(1)).alias("exact"))
    total = keys.count()
    both = exact.join(cms_frequency(keys, exact.select("key"), epsilon, delta), "key")
    return both.select("key", "exact", "estimate", (F.col("estimate") <= F.col("exact") + epsilon * total).alias("within"))


def hll_registers(keys: DataFrame, precision: int, by: list[str] | None = None) -> DataFrame:
    """by..., register, rho: largest rank of the first set bit among the keys of each register."""
    if not 4 <= precision <= 16:
        raise ValueError("precision must be 4 to 16")
    by = by or []
    h = portable_hash(F.col("key"), 0)
    rest = 32 - precision
    rho = trailing_zeros(h.bitwiseAND(F.lit((1 << rest) - 1)), rest) + 1
    return keys.select(*by, "key").distinct().groupBy(*by, F.shiftright(h, rest).cast("int").alias("register")).agg(F.max(rho).alias("rho"))


def hll_estimate(registers: DataFrame, precision: int, by: list[str] | None = None) -> DataFrame:
    """by..., estimate: distinct keys, to the nearest integer; linear counting for small sets."""
    by = by or []
    m = 1 << precision
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    sums = registers.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("s"), F.count(F.lit(1)).alias("used"))
    empty = m - F.col("used")
    raw = alpha * m * m / (F.coalesce("s", F.lit(0.0)) + empty)
    small = (raw <= 2.5 * m) & (empty > 0)
    return sums.select(*by, F.round(F.when(small, m * F.log(m / F.when(empty > 0, empty).otherwise(1))).otherwise(raw)).cast("bigint").alias("estimate"))


def hll_builtin(keys: DataFrame, precision: int, by: list[str]) -> DataFrame:
    """The same count by Spark's own sketches: by..., sketch_estimate, approx."""
    return keys.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_sketch_agg("key", precision)).alias("sketch_estimate"), F.approx_count_distinct("key", 0.02).alias("approx"))


def _hash(seed: str, key: str = "key") -> str:
    return f"('0x' || substr(md5({seed} || ':' || {key}), 1, 8))::BIGINT"


_CELLS = f"SELECT k.*, r.r::INT AS row, {_hash('r.r')} % 272 AS bucket FROM {{0}} k, range(6) r(r)"
_HLL = f"{_hash(chr(39) + '0' + chr(39))}"


def _hll_sql(by: str) -> str:
    lead = f"{by}, " if by else ""
    return f"""r AS (SELECT {lead}({_HLL} >> 20)::INT AS register,
        max(CASE WHEN {_HLL} & 1048575 = 0 THEN 20 ELSE bit_count(({_HLL} & 1048575) & -({_HLL} & 1048575)) * 0 + bit_count((({_HLL} & 1048575) & -({_HLL} & 1048575)) - 1) END + 1)::INT AS rho
      FROM ops WHERE op = 'put' GROUP BY ALL)"""


_ESTIMATE = """round(CASE WHEN raw <= 2.5 * 4096 AND empty > 0 THEN 4096 * ln(4096 / CASE WHEN empty > 0 THEN empty ELSE 1 END) ELSE raw END)::BIGINT AS estimate"""
_SUMS = "s AS (SELECT {0} 4096 - count(*) AS empty, (0.7213 / (1 + 1.079 / 4096)) * 4096 * 4096 / (sum(2.0::DOUBLE ** -rho) + 4096 - count(*)) AS raw FROM r GROUP BY ALL)"

ORACLES = {
    "bloom_saved": f"WITH {SQL}, k AS (SELECT DISTINCT key FROM ops WHERE op = 'put') SELECT DISTINCT {_hash('r.r')} % 9586 AS bit FROM k, range(7) r(r)",
    "bloom_sizing": _RUNS + ", n AS (SELECT level, gen, count(*) AS n FROM run GROUP BY level, gen), b AS (SELECT *, ceil(n * abs(ln(0.01)) / (ln(2) * ln(2)))::BIGINT AS bits FROM n) SELECT level, gen, n, bits, ceil(bits / n * ln(2))::BIGINT AS hashes FROM b",
    "bloom_semi_join": "SELECT c_custkey::VARCHAR AS key, c_name AS name FROM customer WHERE c_custkey::VARCHAR IN (SELECT user_id::VARCHAR FROM events)",
    "cms_matrix": f"WITH {SQL}, k AS (SELECT key FROM ops WHERE op = 'put'), c AS ({_CELLS.format('k')}) SELECT row, bucket, count(*) AS count FROM c GROUP BY row, bucket",
    "cms_frequency": f"""WITH {SQL}, k AS (SELECT key FROM ops WHERE op = 'put'), c AS ({_CELLS.format('k')}), m AS (SELECT row, bucket, count(*) AS n FROM c GROUP BY row, bucket),
      a AS (SELECT c_custkey::VARCHAR AS key FROM customer), q AS ({_CELLS.format('a')}) SELECT key, min(coalesce(n, 0)) AS estimate FROM q LEFT JOIN m USING (row, bucket) GROUP BY key""",
    "cms_named": f"WITH {SQL}, k AS (SELECT category, key FROM ops WHERE op = 'put'), c AS ({_CELLS.format('k')}), m AS (SELECT category, row, bucket, count(*) AS n FROM c GROUP BY ALL) SELECT category, key, min(n) AS estimate FROM c JOIN m USING (category, row, bucket) GROUP BY category, key",
    "cms_bounds": f"""WITH {SQL}, k AS (SELECT key FROM ops WHERE op = 'put'), c AS ({_CELLS.format('k')}), m AS (SELECT row, bucket, count(*) AS n FROM c GROUP BY row, bucket),
      e AS (SELECT key, count(*) AS exact FROM k GROUP BY key), f AS (SELECT key, min(n) AS estimate FROM c JOIN m USING (row, bucket) GROUP BY key)
      SELECT key, exact, estimate, estimate <= exact + 0.01 * (SELECT count(*) FROM k) AS within FROM e JOIN f USING (key)""",
    "hll_registers": f"WITH {SQL}, {_hll_sql('')} SELECT register, rho FROM r",
    "hll_estimate": f"WITH {SQL}, {_hll_sql('')}, {_SUMS.format('')} SELECT {_ESTIMATE} FROM s",
    "hll_named": f"WITH {SQL}, {_hll_sql('category')}, {_SUMS.format('category,')} SELECT category, {_ESTIMATE} FROM s",
}
