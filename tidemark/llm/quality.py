"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives P and unlabelled text U fit a linear model by minimising
prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]), l the logistic loss. No
negative is ever shown to the model: the class prior is estimated from the same two samples (best bin: the smallest ratio of the
shares of U and P above a score, on halves that the scores weren't fitted on), and the cut is where the same risk with
errors counted, not weighed, is smallest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .features import quality_features
from .toxicity import judge

BITS = 18
#: Positives and unlabelled documents that the fit uses at most: those of the smallest hashes of their id; and features of all of them.
MOST_POSITIVE, MOST_UNLABELLED, MOST_FEATURES = 5_000, 10_000, 30_000_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def risk_slopes(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Along which slopes of the margins of positives and unlabelled rows the non-negative risk is descended."""
    loss = lambda x: np.logaddexp(0, -x)
    down_p, down_u = prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
    if loss(-fu).mean() >= prior * loss(-fp).mean():
        return -prior * _sigmoid(-fp) / len(fp) - down_p, down_u
    return down_p, -down_u  # the part that can't be negative is: go back up along it


def shares_above(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every score that occurs, and the shares of positives and of unlabelled rows that reach it."""
    at = np.unique(np.concatenate([positive, unlabelled]))
    return at, *(1 - np.searchsorted(np.sort(x), at, "left") / len(x) for x in (positive, unlabelled))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1, slack: float = 0.01) -> float:
    """Share of positives among the unlabelled by their scores: the ratio of shares above a score, where its upper bound is smallest."""
    _, p, u = shares_above(positive, unlabelled)
    width = sum((np.log(4 / doubt) / (2 * len(x))) ** 0.5 for x in (positive, unlabelled))
    p, u = p[p > 0], u[p > 0]
    best = int(np.argmin((u + (1 + slack) * width) / p))
    return float(min(max(u[best] / p[best], 0.01), 0.99))


def risk_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The smallest margin, half way to the one below it, above which taking rows as positive has the least non-negative risk."""
    at, p, u = shares_above(positive, unlabelled)
    best = int(np.argmin(prior * (1 - p) + np.maximum(0, u - prior * p)))
    return float((at[best] + at[max(best - 1, 0)]) / 2)


class PuModel:
    """Linear model over sparse rows, fitted by AdaGrad on mixed batches."""

    def __init__(self, bits: int = BITS, rate: float = 1.0, l2: float = 1e-6):
        self.w, self.g = np.zeros(1 << bits), np.full(1 << bits, 1e-2)
        self.b, self.bg, self.rate, self.l2 = 0.0, 1e-2, rate, l2

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([self.w[f] @ v for f, v in rows]) + self.b

    def step(self, rows: list, slope: np.ndarray) -> None:
        """One descent step along the sum of slope * row."""
        f = np.concatenate([x for x, _ in rows])
        g = np.concatenate([v * s for (_, v), s in zip(rows, slope, strict=True)])
        order = np.argsort(f, kind="stable")
        f, g = f[order], g[order]
        first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        at, g = f[first], np.add.reduceat(g, first)
        g = g + self.l2 * self.w[at]
        self.g[at] += g * g
        self.w[at] -= self.rate * g / np.sqrt(self.g[at])
        gb = float(slope.sum())
        self.bg += gb * gb
        self.b -= self.rate * gb / self.bg**0.5

    def tell_apart(self, positive: list, unlabelled: list, epochs: int = 3, batch: int = 128, seed: int = 5) -> None:
        """Logistic regression of positives against unlabelled rows."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(unlabelled))
            for i in range(0, len(order), batch):
                u = [unlabelled[k] for k in order[i : i + batch]]
                p = [positive[k] for k in rng.integers(0, len(positive), len(u))]
                self.step(p + u, np.concatenate([-_sigmoid(-self.margins(p)), _sigmoid(self.margins(u))]) / len(u))

    def fit(self, positive: list, unlabelled: list, prior: float, epochs: int = 8, batch: int = 128, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(unlabelled))
            for i in range(0, len(order), 2 * batch):
                u = [unlabelled[k] for k in order[i : i + 2 * batch]]
                p = [positive[k] for k in rng.integers(0, len(positive), batch)]
                self.step(p + u, np.concatenate(risk_slopes(self.margins(p), self.margins(u), prior)))
        self.b -= risk_cut(self.margins(positive), self.margins(unlabelled), prior)


def estimated_prior(positive: list, unlabelled: list, bits: int) -> float:
    """The class prior, by scores of the halves that a model of the other halves gives."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    model = PuModel(bits)
    model.tell_apart(positive[::2], unlabelled[::2])
    return class_prior(model.margins(positive[1::2]), model.margins(unlabelled[1::2]))


def fit(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, most_positive: int, most_unlabelled: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias), fitted in one task on a bounded sample of the training rows.

    Of rows that share an id the smallest text counts. Rows that would bring the sample above ``MOST_FEATURES`` are left out, by the order of their hashes.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (common.crc_share("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    h = F.xxhash64("_id")
    positive = known.where("y = 1").select(F.col("doc_id").alias("_id"), F.lit(1).alias("y")).orderBy(h, "_id").limit(most_positive)
    pool = docs.where(F.col("doc_id").isNotNull() & (common.crc_share("doc_id", folds) != held_out)).select(F.col("doc_id").alias("_id"), F.lit(0).alias("y"))
    unlabelled = pool.orderBy(F.xxhash64(F.lit(1), "_id"), "_id").limit(most_unlabelled)
    chosen = F.broadcast(positive.unionByName(unlabelled))  # bounded by the two limits
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(chosen, "_id").groupBy(h.alias("h"), "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in common.slices(batches, "text"):
            doc, feature, value = quality_features(found, bits)
            cuts = np.searchsorted(doc, np.arange(len(found) + 1))
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([feature[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()), pa.array([value[a:b].astype("<f4").tobytes() for a, b in spans], pa.binary())], ["h", "y", "f", "v"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        room = MOST_FEATURES
        for b in batches:
            for y, f, v in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                room -= len(f) // 4
                if room >= 0:
                    sides[y].append((np.frombuffer(f, "<u4").astype(np.int32), np.frombuffer(v, "<f4")))
        model = PuModel(bits)
        if sides[0] and sides[1]:
            model.fit(sides[1], sides[0], estimated_prior(sides[1], sides[0], bits))
        at = np.flatnonzero(model.w)
        yield pa.RecordBatch.from_arrays([pa.array([model.b]), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([model.w[at].astype("<f8").tobytes()], pa.binary())], ["bias", "features", "weights"])

    found = rows.mapInArrow(extract, "h bigint, y int, f binary, v binary").repartition(1).sortWithinPartitions("h", "y", "f").mapInArrow(learn, "bias double, features binary, weights binary").collect()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(found[0]["features"], "<u4").astype(np.int64), np.frombuffer(found[0]["weights"], "<f8"), found[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """doc_id, score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**bits numbers
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, bias = sent.value
        w = np.zeros(1 << bits)
        w[features] = weights
        for part, found in common.slices(batches, "text"):
            doc, feature, value = quality_features(found, bits)
            total = bias + np.bincount(doc, weights=w[feature] * value, minlength=len(found))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_sigmoid(total))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from rows outside fold ``held_out`` of crc32(doc_id) mod ``folds``. Null and empty texts are scored by their
    statistics like any other. Only labels 1 are used. Null labels and ids are not learnt from; a null id is not held out. Repeated rows score alike.
    Without labels every score is 0.5. An empty table gives no rows. Other columns play no part.
    """
    common.tune(docs.sparkSession)
    return judge(score(docs, fit(docs, labels, folds, held_out, most_positive, most_unlabelled)), folds, held_out)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
