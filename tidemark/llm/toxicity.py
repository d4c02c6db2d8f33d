"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .features import distinct, gram_features

#: Features are hashed to so many bits.
BITS = 22
#: Labelled documents that the fit uses at most: those of the smallest hashes of their id; and features of all of them.
MOST_TRAINING, MOST_FEATURES = 16_000, 60_000_000


class Ftrl:
    """Binary features; per-coordinate rates, L1 and L2. The bias has no penalty."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, features: np.ndarray, label: int) -> None:
        w, b = self.weights(features), self.bias()
        g = 1 / (1 + np.exp(-np.clip(b + w.sum(), -35, 35))) - label
        n = self.n[features]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[features] += g - sigma * w
        self.n[features] = n + g * g
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += g * g


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h, y, text of at most ``most`` labelled training documents, by the smallest hashes of their ids; of rows that share an id the smallest text."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (common.crc_share(id_col, folds) != held_out)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.withColumn("h", F.xxhash64("_id")).orderBy("h", "_id").limit(most)
    # At most ``most`` rows of three numbers, so their broadcast is bounded.
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").groupBy("h", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def fit(rows: DataFrame, bits: int = BITS, epochs: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias): the weights that are not zero, from rows (h, y, text), learnt in order of h in one task.

    Rows that would bring the sample above ``MOST_FEATURES`` are left out, in that order.
    """

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in common.slices(batches, "text"):
            doc, feature, _ = distinct(*gram_features(found, bits), bits)
            cuts = np.searchsorted(doc, np.arange(len(found) + 1))
            blobs = [feature[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blobs, pa.binary())], ["h", "y", "features"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, room = [], MOST_FEATURES
        for b in batches:
            for y, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                room -= len(f) // 4
                if room >= 0:
                    rows.append((np.frombuffer(f, "<u4"), y))
        if not rows:
            return
        model = Ftrl(bits)
        for _ in range(epochs):
            for features, y in rows:
                model.learn(features, y)
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([model.bias()]), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([w[at].astype("<f8").tobytes()], pa.binary())], ["bias", "features", "weights"])

    features = rows.select("h", "y", "text").mapInArrow(extract, "h bigint, y int, features binary")
    found = features.repartition(1).sortWithinPartitions("h", "features").mapInArrow(learn, "bias double, features binary, weights binary").collect()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(found[0]["features"], "<u4").astype(np.int64), np.frombuffer(found[0]["weights"], "<f8"), found[0]["bias"]


def dense(model: tuple[np.ndarray, np.ndarray, float], bits: int) -> tuple[np.ndarray, float]:
    features, weights, bias = model
    w = np.zeros(1 << bits)
    w[features] = weights
    return w, bias


def probabilities(found: list[bytes], w: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """Score of each text, by its distinct features that have a weight."""
    doc, feature = gram_features(found, bits)
    live = w[feature] != 0
    doc, feature, _ = distinct(doc[live], feature[live], bits)
    total = bias + np.bincount(doc, weights=w[feature], minlength=len(found))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: each whole text's probability; null texts count as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**bits numbers
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = dense(sent.value, bits)
        for part, found in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(probabilities(found, w, bias, bits))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"doc_id {kind}, score double")


def judge(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    return scored.select("doc_id", F.coalesce(common.crc_share("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most_training: int = MOST_TRAINING) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labelled documents outside fold ``held_out`` of crc32(doc_id) mod ``folds``.
    Null and empty texts get the score of the bias. Null labels and ids are not learnt from; a null id is not held out.
    Repeated rows score alike, and of unequal labels of one id the largest holds. Without labels every score is 0.5. An empty table gives no
    rows. Other columns, also of the same names, play no part.
    """
    common.tune(docs.sparkSession)
    return judge(score(docs, fit(training_rows(docs, labels, "toxic", folds, held_out, most_training))), folds, held_out)


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, most_training: int = MOST_TRAINING) -> DataFrame:
    """The documents, all columns kept, that ``toxicity`` doesn't predict as toxic.

    Null and empty texts have the score of the bias and stay or go by it; without labels every document would go at 0.5, so
    all stay then. Repeated rows stay or go alike. Null ids are judged like others. Other columns, whatever their names, go along. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.tune(spark)
    bits = BITS
    model = fit(training_rows(docs, labels, "toxic", folds, held_out, most_training))
    if not len(model[0]) and not model[2]:
        return docs
    sent = spark.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = dense(sent.value, bits)
        for part, found in common.slices(batches, "text"):
            yield part.filter(pa.array(probabilities(found, w, bias, bits) < 0.5))

    return docs.mapInArrow(work, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
