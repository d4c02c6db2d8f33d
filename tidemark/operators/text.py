"""256-bit SimHash of texts from the MD5 digits of their words, and pairs within a Hamming distance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hamming

# Words that carry no weight. Case counts.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, word, n: words between single spaces that are no stop words; an empty word counts as one."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), " ")).alias("word"))
    return words.where(~F.col("word").isin(list(STOP_WORDS))).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))


def text_fingerprints(texts: list[str | None]) -> np.ndarray:
    """(text, word) -> the 256 bits as four 64-bit integers; 0 without a word that counts."""
    rows: dict[str, int] = {}
    stop = frozenset(STOP_WORDS)
    docs = [[rows.setdefault(w, len(rows)) for w in (x or "").split(" ") if w not in stop] for x in texts]
    digits = np.frombuffer("".join(md5(w.encode()).hexdigest() for w in rows).encode(), np.uint8).reshape(-1, 32)
    bits = np.unpackbits(digits, axis=1)
    out = np.zeros((len(texts), 32), np.uint8)
    for i, words in enumerate(docs):
        votes = np.zeros(256, np.int64)
        for at in range(0, len(words), 4096):
            votes += bits[words[at : at + 4096]].sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * votes > len(words))
    return out.view(">i8").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, w0..w3: bit k is set where words whose MD5 digits (as text) have it outweigh those that lack it.

    A document's words are all in its row, so they are counted there, batch by batch in numpy, with no shuffle.
    A text of stop words only has all bits 0; a null text is empty, which is one empty word.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = text_fingerprints(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(words[:, i]) for i in range(4))], ["id", "w0", "w1", "w2", "w3"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, w0 bigint, w1 bigint, w2 bigint, w3 bigint")


def near_pairs(prints: DataFrame, radius: int = 7, keep: int = 2) -> DataFrame:
    """id_a, id_b, distance: pairs of classes of equal fingerprints (named by their smallest ids) within ``radius``, exactly.

    radius + keep bands of whole characters: a pair within the radius agrees on ``keep`` bands at least. Every choice of
    ``keep`` bands is a join key, and a pair counts at the first bands it agrees on, so none is listed twice and no distinct is needed.
    """
    n = radius + keep
    if radius < 0 or keep < 1 or n > 32:
        raise ValueError("radius + keep must be at most 32")
    w = [f"w{i}" for i in range(4)]
    classes = prints.groupBy(*w).agg(F.min("id").alias("id"))
    cuts = [32 * i // n for i in range(n + 1)]
    digits = F.concat(*(F.lpad(F.hex(c), 16, "0") for c in w))
    bands = F.array(*(F.substring(digits, 2 * cuts[i] + 1, 2 * (cuts[i + 1] - cuts[i])) for i in range(n)))
    choices = F.array(*(F.struct(F.lit(list(c)).alias("choice"), F.concat(*(F.col("bands")[i] for i in c)).alias("part")) for c in combinations(range(n), keep)))
    keyed = classes.withColumn("bands", bands).select("id", *w, "bands", F.explode(choices).alias("k")).select("id", *w, "bands", "k.*")
    a = keyed.select("choice", "part", F.col("id").alias("id_a"), F.col("bands").alias("bands_a"), *(F.col(c).alias(f"a_{c}") for c in w))
    b = keyed.select("choice", "part", F.col("id").alias("id_b"), F.col("bands").alias("bands_b"), *(F.col(c).alias(f"b_{c}") for c in w))
    distance = hamming([F.col(f"a_{c}") for c in w], [F.col(f"b_{c}") for c in w])
    met = a.join(b, ["choice", "part"]).where("id_a < id_b").withColumn("distance", distance).where(F.col("distance") <= radius)
    agreed = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("bands_a")[i] == F.col("bands_b")[i])
    return met.where(F.slice(agreed, 1, keep) == F.col("choice")).select("id_a", "id_b", "distance")


_WORDS = "', '".join(STOP_WORDS)
_PRINTS = f"""t AS (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), ' ')) AS word FROM documents),
  c AS (SELECT id, word, count(*) AS n FROM t WHERE word NOT IN ('{_WORDS}') GROUP BY id, word),
  x AS (SELECT id, n, p, ascii(substr(md5(word), p + 1, 1)) AS a FROM c, range(32) r(p)),
  v AS (SELECT id, p, sum(n) AS n, {', '.join(f"sum(n * ((a >> {k}) & 1)) AS s{k}" for k in range(8))} FROM x GROUP BY id, p),
  b AS (SELECT id, p // 8 AS w, sum(({' + '.join(f"(2 * s{k} > n)::INT * {1 << k}" for k in range(8))})::HUGEINT << (56 - 8 * (p % 8))::INT)::UBIGINT AS f FROM v GROUP BY id, w),
  f AS (SELECT d.doc_id AS id, {', '.join(f"coalesce(max(f) FILTER (w = {w}), 0)::UBIGINT AS w{w}" for w in range(4))} FROM documents d LEFT JOIN b ON b.id = d.doc_id GROUP BY d.doc_id)"""
_SIGNED = ", ".join(f"(CASE WHEN w{w} >= 9223372036854775808 THEN w{w}::HUGEINT - 18446744073709551616 ELSE w{w}::HUGEINT END)::BIGINT AS w{w}" for w in range(4))

ORACLES = {
    "simhash_fingerprint": f"WITH {_PRINTS} SELECT id, {_SIGNED} FROM f",
    "simhash_pairs": f"""WITH {_PRINTS}, k AS (SELECT min(id) AS id, w0, w1, w2, w3 FROM f GROUP BY w0, w1, w2, w3),
      d AS (SELECT a.id AS id_a, b.id AS id_b, {' + '.join(f"bit_count(xor(a.w{w}, b.w{w}))::INT" for w in range(4))} AS distance FROM k a JOIN k b ON a.id < b.id)
      SELECT id_a, id_b, distance FROM d WHERE distance <= 7""",
    "word_frequencies": f"WITH t AS (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), ' ')) AS word FROM documents) SELECT id, word, count(*) AS n FROM t WHERE word NOT IN ('{_WORDS}') GROUP BY id, word",
}
