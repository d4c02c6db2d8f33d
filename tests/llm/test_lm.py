"""Language-model scores against plain counting and plain EM."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import lm
from tidemark.llm.blocks import squeeze, stretch


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    """Counts in dictionaries, one token at a time, and plain EM over the training tokens."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    uni, bi, tri = Counter(), Counter(), Counter()
    docs = [(i, tokens(x)) for i, x in rows]
    grams = lambda t: list(zip(["<s>", "<s>", *t][: len(t)], ["<s>", *t][: len(t)], t, strict=True))
    texts = 0
    for i, t in docs:
        if not held(i):
            texts += 1
            uni.update(t)
            bi.update((b, c) for _, b, c in grams(t))
            tri.update(grams(t))
    n, v = sum(uni.values()), len(uni)

    def seen(a, b, c, less=0):
        """Class and the four estimates, every count less by ``less``."""
        two = (texts if b == "<s>" else bi[a, b]) - less
        one = (texts if b == "<s>" else uni[b]) - less
        kind = ("two", two.bit_length()) if two > 0 else ("one", one.bit_length()) if one > 0 else ("none", 0)
        ratio = lambda x, of: (x - less) / of if of > 0 else 0.0
        return kind, [ratio(tri[a, b, c], two), ratio(bi[b, c], one), (uni[c] - less) / max(n - less, 1), 1 / (v + 1)]

    first = {"two": [0.4, 0.3, 0.2, 0.1], "one": [0, 0.4, 0.4, 0.2], "none": [0, 0, 0.5, 0.5]}
    weights = {}

    def weigh(kind):
        name, size = kind
        while size > 1 and (name, size) not in weights:
            size -= 1
        return weights.get((name, size), first[name])

    for turn in range(60):
        sums = {}
        for i, t in docs:
            if not held(i):
                for g in grams(t):
                    kind, est = seen(*g, less=1)
                    part = [w * e for w, e in zip(first[kind[0]] if turn == 0 else weigh(kind), est, strict=True)]
                    sums.setdefault(kind, [0.0] * 4)
                    for j in range(4):
                        sums[kind][j] += part[j] / sum(part)
        weights = {}
        for kind, s in sums.items():
            w = [max(x / sum(s), 1e-6 if f else 0) for x, f in zip(s, first[kind[0]], strict=True)]
            weights[kind] = [x / sum(w) for x in w]
    out = []
    for i, t in docs:
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = 0.0
        for g in grams(t):
            kind, est = seen(*g)
            score += math.log10(sum(w * e for w, e in zip(weigh(kind), est, strict=True)))
        out.append((i, held(i), len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    # The fit rounds ratios of estimates, so the weights are near those of the plain one only.
    off = np.abs(np.array([r[6] for r in got]) / np.array([r[6] for r in want]) - 1)
    assert off.max() < 0.03 and np.median(off) < 0.003


def test_scores_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = ["the", "The", "cat", "sat", "on", "a", "mat", "É", "verylongwordindeed", "x\x00y", "z\xa0z"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 40)))) + ["", " \n", "\t end"][i % 3] for i in range(120)]
    rows = [*enumerate(texts), (500, None), (501, ""), (502, "the cat " * 500), (3, texts[3]), (None, "the mat")]
    monkeypatch.setattr(lm, "BLOCK_BYTES", 700)
    df = spark.createDataFrame([(i, x, True, 1) for i, x in rows], "doc_id long, text string, train boolean, block int").repartition(3)
    same(lm.score_texts(df).collect(), brute(rows))
    same(lm.score_texts(df.unionByName(df)).collect(), brute(rows * 2))
    # An input without an order of its own, over many small buckets.
    monkeypatch.setattr(lm, "BUCKET_BYTES", 500)
    same(lm.score_texts(df.repartition(5, "text").orderBy(F.rand())).collect(), brute(rows))


def test_held_out_beats_base(spark):
    rng = np.random.default_rng(1)
    follow = {w: rng.choice(60, 3) for w in range(60)}
    rows = []
    for i in range(300):
        w, out = 0, []
        for _ in range(50):
            w = int(rng.choice(follow[w]))
            out.append(f"w{w}")
        rows.append((i, " ".join(out)))
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)


def test_edge_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert lm.score_texts(make([])).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = lm.score_texts(make([(held, "a b")])).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0) and row["score"] <= 0


@pytest.mark.parametrize("a", [[], [0], [5, 0, 2**63, 255, 256]])
def test_squeeze_round_trip(a):
    assert stretch(squeeze(np.array(a, np.uint64))).tolist() == a
