"""Language-model scoring by deleted interpolation of trigram, bigram, unigram and uniform estimates.

Counting never moves tokens. Each block of documents sends its distinct n-grams with
their counts, as sorted and compressed 64-bit hashes, to buckets of the hash; a bucket adds up what all blocks sent
and answers each block with the totals, in the block's own order. An n-gram that every document holds costs a bucket one entry per
block. The mixture weights, one set for each power of two of the context's count, come from expectation-maximisation
over deleted counts: every training token is held out in turn, its own occurrence taken off all counts. For it, tokens are counted
by class and by the ratios of their estimates, in steps of an octave's ``STEPS``-th part; a class's counts, which are bounded, go to one task, and
the driver sees four weights a class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .blocks import SENT_DDL, WHOLE, bucket_bits, bucket_cuts, by_bucket, cut_blocks, each_block, frame, open_block, ranked, rows, runs, squeeze, stretch, unframe
from .features import chain

#: Hashes that stand for the end of a text and for what stands before its first word.
END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
UNIGRAM, BIGRAM, TRIGRAM = KINDS = 0, 1, 2
#: Kinds that are sent and added up at a time: what a round sends is off the disk before the next one.
SENT_KINDS = ((UNIGRAM, BIGRAM), (TRIGRAM,))
#: Text bytes of a block, and of what goes to one bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Rounds of expectation-maximisation.
ROUNDS = 60
#: Steps of an octave to which the ratios of estimates to the uniform one are rounded for the fit, and octaves above and below it that are told apart:
#: at most (STEPS * OCTAVES + 1) ** 3 counts a class, whatever the corpus.
STEPS, OCTAVES = 8, 40
#: Classes of contexts: unseen; one word, by the power of two of its count, after two unseen together; two words, likewise.
ONE, TWO, CLASSES = 1, 65, 129
#: Weights of trigram, bigram, unigram and uniform estimate to start from, from the class on.
FIRST = {0: (0.0, 0.0, 0.5, 0.5), ONE: (0.0, 0.4, 0.4, 0.2), TWO: (0.4, 0.3, 0.2, 0.1)}
LEAST = 1e-6


class Block:
    """The tokens of some documents: by kind, the distinct n-grams, where they stand and their training counts."""

    def __init__(self, found: list[bytes], train: np.ndarray, kinds: tuple[int, ...] = KINDS):
        data, starts, ends, counts = common.words_of(found)
        h = common.hash_spans(data, starts, ends)
        self.lengths = counts + 1
        last = np.cumsum(self.lengths) - 1
        first = last + 1 - self.lengths
        tokens = np.full(int(self.lengths.sum()), END)
        word = np.ones(len(tokens), bool)
        word[last] = False
        tokens[word] = h
        before = np.concatenate(([START], tokens[:-1]))
        before[first] = START
        pairs = chain(before, tokens, 5)
        earlier = np.concatenate(([START], before[:-1]))
        earlier[first] = START
        weight = np.repeat(train.astype(np.int64), self.lengths)
        self.keys, self.rank, self.counts = {}, {}, {}
        for kind in kinds:
            x = tokens if kind == UNIGRAM else pairs if kind == BIGRAM else chain(earlier, pairs, 6)
            self.keys[kind], self.rank[kind] = ranked(x)
            self.counts[kind] = np.bincount(self.rank[kind], weights=weight, minlength=len(self.keys[kind])).astype(np.int64)


def _opened(payload: bytes, kinds: tuple[int, ...] = KINDS) -> tuple[pa.Array, np.ndarray, Block]:
    columns, found = open_block(payload)
    train = np.array(columns.column("train").to_pylist(), bool)
    return columns.column("doc_id").combine_chunks(), train, Block(found, train, kinds)


def totals(blocks: DataFrame, bits: int, kinds: tuple[int, ...] = KINDS) -> DataFrame:
    """For each block, one of the kinds and bucket: the training totals of the block's n-grams (payload), written to the shared folder.

    Rows of block -1 hold, by bucket of unigrams, the number of distinct training tokens and of all.
    """

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, payload in each_block(batches):
            block, out = _opened(payload, kinds)[2], []
            for kind in kinds:
                keys = block.keys[kind]
                cuts = bucket_cuts(keys, bits)
                for bucket, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if b > a:
                        out.append((name, kind, bucket, frame([squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(block.counts[kind][a:b])])))
            yield rows(out)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(at: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            parts = [[stretch(x) for x in unframe(p)] for *_, p in held]
            keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts])
            _, rank = ranked(keys)
            sums = np.bincount(rank, weights=np.concatenate([c for _, c in parts]).astype(np.float64)).astype(np.int64)
            back, out, i = sums[rank], [], 0
            for (name, *_), (k, _) in zip(held, parts, strict=True):
                out.append((name, *at, squeeze(back[i : i + len(k)])))
                i += len(k)
            if at[0] == UNIGRAM:
                out.append((-1, *at, squeeze(np.array([np.count_nonzero(sums), sums.sum()]))))
            yield rows(out)

        return runs(batches, 2, close, skip=1)

    sent = by_bucket(blocks.mapInArrow(send, SENT_DDL), bits, "kind", "bucket", "block")
    return common.materialize(sent.mapInArrow(add, SENT_DDL), "ngram-totals")


def counted(blocks: DataFrame, sums: DataFrame) -> DataFrame:
    """Per block (payload): ids, lengths, which documents train, and each token's totals as word, pair and triple; written to the shared folder."""

    def close(at: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        (whole,) = (p for _, kind, _, p in held if kind == WHOLE)
        ids, train, block = _opened(whole)
        found = {kind: np.concatenate([stretch(p) for _, k, _, p in held if k == kind]) for kind in KINDS}
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([ids], ["doc_id"]))
        yield rows([(*at, WHOLE, 0, frame([sink.getvalue().to_pybytes(), squeeze(block.lengths), squeeze(train), *(squeeze(found[kind][block.rank[kind]]) for kind in KINDS)]))])

    n = common.partitions(blocks.sparkSession)
    both = blocks.unionByName(sums.where("block >= 0"))
    met = both.repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")
    return common.materialize(met.mapInArrow(lambda b: runs(b, 1, close), SENT_DDL), "ngram-counts")


def context_class(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The class of a context by the training counts of its two words together and of its last word."""
    power = lambda x: np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    return np.where(two > 0, TWO + power(two), np.where(one > 0, ONE + power(one), 0))


class Counted:
    """A block's tokens with the totals of their n-grams."""

    def __init__(self, payload: bytes, texts: int):
        parts = unframe(payload)
        self.ids, (lengths, train, *found) = parts[0], (stretch(x) for x in parts[1:])
        self.lengths, self.train = lengths.astype(np.int64), train.astype(bool)
        self.word, self.pair, self.triple = (x.astype(np.int64) for x in found)
        self.first = np.cumsum(self.lengths) - self.lengths
        # A text's first word stands after the start alone, which stands once in each training text.
        self.one, self.two = (np.concatenate(([texts], x[:-1])) for x in (self.word, self.pair))
        self.one[self.first] = self.two[self.first] = texts

    def estimates(self, n: int, v: int, held_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(class, estimates by trigram, bigram, unigram and uniform) of all tokens; or of the training tokens, each taken off all counts."""
        found = (self.triple, self.two, self.pair, self.one, self.word)
        if held_out:
            live = np.repeat(self.train, self.lengths)
            found, n = [x[live] - 1 for x in found], n - 1
        triple, two, pair, one, word = found
        out = np.empty((4, len(word)))
        out[0], out[1], out[2], out[3] = triple / np.maximum(two, 1), pair / np.maximum(one, 1), word / max(n, 1), 1 / (v + 1)
        return context_class(two, one), out


def filled(weights: dict[int, list[float]]) -> np.ndarray:
    """(class, weight): the learnt weights; a class without any has those of the one below it, or those to start from."""
    out = np.zeros((CLASSES, 4))
    for k in range(CLASSES):
        out[k] = weights.get(k, FIRST[k] if k in FIRST else out[k - 1])
    return out


def deleted_cells(payload: bytes, texts: int, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, tokens) of a block's training tokens. A cell's bits: class, then three steps, 0 for an estimate of 0."""
    kind, share = Counted(payload, texts).estimates(n, v, held_out=True)
    cell = kind
    for x in share[:3]:
        step = np.rint(np.log2(np.maximum(x / share[3], 2.0**-OCTAVES)) * STEPS).astype(np.int64) + STEPS * OCTAVES // 4
        cell = cell << 16 | np.where(x > 0, np.clip(step + 1, 1, STEPS * OCTAVES), 0)
    return np.unique(cell, return_counts=True)


def maximise(kind: int, cells: np.ndarray, tokens: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The weights of a class that make its held-out tokens likely."""
    steps = np.stack([cells >> 32, cells >> 16, cells]) & 0xFFFF
    likely = np.ones((4, len(cells)))
    likely[:3] = np.where(steps > 0, 2.0 ** ((steps - 1 - STEPS * OCTAVES // 4) / STEPS), 0)
    first = w = np.array(FIRST[TWO if kind >= TWO else ONE if kind else 0])
    for _ in range(rounds):
        share = likely * w[:, None]
        w = (share / share.sum(axis=0)) @ tokens
        w = np.maximum(w / w.sum(), np.where(first > 0, LEAST, 0))
        w /= w.sum()
    return w


def learn_weights(blocks: DataFrame, texts: int, n: int, v: int) -> np.ndarray:
    """Mixture weights (class, estimate) that make the held-out training tokens likely, by expectation-maximisation."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payload in each_block(batches):
            cells, tokens = deleted_cells(payload, texts, n, v)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(tokens)], ["cell", "tokens"])

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = [b for b in batches if b.num_rows]
        if held:
            found = pa.Table.from_batches(held)
            kind, cell, tokens = (found.column(i).to_numpy() for i in range(3))
            cuts = [*np.flatnonzero(np.diff(kind, prepend=-1)).tolist(), len(kind)]
            out = [(int(kind[a]), maximise(int(kind[a]), cell[a:b], tokens[a:b].astype(np.float64)).tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([w for _, w in out], pa.list_(pa.float64()))], ["class", "weights"])

    cells = blocks.mapInArrow(count, "cell bigint, tokens bigint").groupBy("cell").agg(F.sum("tokens").alias("tokens"))
    named = cells.select(F.shiftright("cell", 48).cast("int").alias("class"), "cell", "tokens")
    fitted = named.repartitionById(CLASSES, F.col("class")).sortWithinPartitions("class", "cell").mapInArrow(fit, "class int, weights array<double>")
    return filled({r["class"]: r["weights"] for r in fitted.collect()})


def score_texts(docs: DataFrame, folds: int = 10, held_out: int = 0) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents outside fold ``held_out`` of crc32(doc_id) mod ``folds``. A text is its words, A-Z lower-cased, and an end.

    Null and empty texts are the end alone. A null id is not held out. Repeated rows count and are scored
    each. Without training rows every text scores by the uniform estimate. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    common.tune(spark)
    kind = docs.schema["doc_id"].dataType
    held = F.coalesce(common.crc_share("doc_id", folds) == held_out, F.lit(False))
    d = docs.select("doc_id", (~held).alias("train"), "text")
    size = d.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if("train").alias("texts")).head()
    texts = size["texts"]
    bits = bucket_bits(size["bytes"] or 0, common.partitions(spark), BUCKET_BYTES)
    blocks = cut_blocks(d, BLOCK_BYTES, "lm-blocks")
    sums = reduce(DataFrame.unionByName, [totals(blocks, bits, kinds) for kinds in SENT_KINDS])
    v = n = 0
    for r in sums.where("block = -1").select("payload").toLocalIterator():  # one row per bucket
        a, b = stretch(bytes(r["payload"])).tolist()
        v, n = v + a, n + b
    tokens = counted(blocks, sums)
    common.discard(sums)
    common.discard(blocks)
    lam = learn_weights(tokens, texts, n, v)
    arrow = to_arrow_type(kind)

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payload in each_block(batches):
            c = Counted(payload, texts)
            at, p = c.estimates(n, v)
            p *= lam.T[:, at]
            add = lambda x: np.add.reduceat(x, c.first)
            base = np.log10((c.word + 0.1) / (n + 0.1 * (v + 1)))
            with pa.ipc.open_stream(pa.BufferReader(c.ids)) as r:
                ids = r.read_all().column(0).combine_chunks().cast(arrow)
            yield pa.RecordBatch.from_arrays([ids, pa.array(~c.train), pa.array(c.lengths), pa.array(add((c.word > 0).astype(np.int64))), pa.array(np.full(len(c.lengths), n)), pa.array(add(base)), pa.array(add(np.log10(p.sum(axis=0))))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return tokens.mapInArrow(scores, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op9_lm_scores(spark, sf_dir: str) -> DataFrame:
    return score_texts(common.table(spark, sf_dir, "documents"))
