"""Toxicity and quality: features against plain Python, held-out accuracy, edge cases."""

import re
import zlib

import numpy as np
import pytest
from tidemark.llm import quality, toxicity
from tidemark.llm.features import distinct, gram_features, quality_features


def corpus(spark, n=1500):
    """Documents of random words; toxic ones hold a marker word, poor ones shout or repeat lines."""
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, 60))
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.8)
        if toxic:
            words[int(rng.integers(0, 60))] = ["Awful", "nasty!", "vileness"][i % 3]
        text = " ".join(words)
        if not good:
            text = text.upper().replace(" ", "!! ") if i % 2 else (text[:50] + "\n") * 9
        docs.append((i, text, 5, "x"))
        if i % 3:
            labels.append((i, good, toxic, "t"))
    return spark.createDataFrame(docs, "doc_id long, text string, quality int, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), labels


def test_gram_features_match_plain_words():
    texts = [b"One two-three, one", b"", b"  ", "Éa b9 c_d".encode(), b"longerword longerwood"]
    doc, feature = gram_features(texts, 40)
    for i, x in enumerate(texts):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in x))
        want = len(words) + sum(len(w) > 6 for w in words) + max(0, len(words) - 1) + max(0, len(words) - 2)
        assert (doc == i).sum() == want
    assert len(set(feature[doc == 4].tolist())) == 2 + 1 + 1


def test_batches_do_not_change_features():
    texts = [b"", b"Aa bb!! cc", b"x\nx\nx", "é ".encode() * 50, b" "]
    together = quality_features(texts, 18)
    for i, x in enumerate(texts):
        alone = quality_features([x], 18)
        mine = together[0] == i
        assert sorted(zip(alone[1].tolist(), alone[2].round(9).tolist(), strict=True)) == sorted(zip(together[1][mine].tolist(), together[2][mine].round(9).tolist(), strict=True))
    assert distinct(np.array([1, 0, 1]), np.array([5, 5, 5]), 8)[2].tolist() == [1, 2]


@pytest.mark.parametrize(("run", "folds", "held", "at", "least"), [(toxicity.toxicity, 5, 0, 2, 0.95), (quality.quality, 3, 1, 1, 0.95)])
def test_held_out_accuracy(spark, run, folds, held, at, least):
    docs, labels, rows = corpus(spark)
    got = {r["doc_id"]: r for r in run(docs, labels).collect()}
    assert len(got) == 1500
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % folds == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    right = [got[r[0]]["predicted"] == r[at] for r in rows if got[r[0]]["held_out"]]
    assert sum(right) / len(right) >= least
    # Held-out labels play no part.
    flipped = labels.selectExpr("doc_id", f"if(pmod(crc32(cast(cast(doc_id as string) as binary)), {folds}) = {held}, 1 - quality, quality) quality", f"if(pmod(crc32(cast(cast(doc_id as string) as binary)), {folds}) = {held}, 1 - toxic, toxic) toxic")
    again = {r["doc_id"]: r["score"] for r in run(docs, flipped).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-12 for i, r in got.items())


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_edge_tables(spark, run):
    docs, labels, _ = corpus(spark, 60)
    odd = spark.createDataFrame([(None, "a b"), (7, None), (7, ""), (7, ""), (None, None), (8, " \n"), (9, "word " * 30000)], "doc_id long, text string")
    rows = run(odd, labels.unionByName(spark.createDataFrame([(None, 1, 1, ""), (3, None, None, "")], labels.schema))).collect()
    assert len(rows) == 7 and all(r["score"] is not None and r["held_out"] is not None for r in rows)
    assert run(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in run(odd, labels.limit(0)).collect()} == {0.5}


def test_ftrl_bias_and_sparsity():
    m = toxicity.Ftrl(8, l1=1.0)
    for _ in range(50):
        m.learn(np.array([3]), 1)
        m.learn(np.array([5]), 0)
    assert m.weights()[3] > 0 > m.weights()[5] and np.count_nonzero(m.weights()) == 2


def plain_ftrl(rows, epochs, alpha=0.5, beta=1.0, l1=8.0, l2=0.5):
    """The published update, a coordinate at a time."""
    z, n, bz, bn = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for features, y in rows:
            b = -bz / ((beta + bn**0.5) / alpha)
            w = {i: weight(i) for i in features}
            g = 1 / (1 + np.exp(-(b + sum(w.values())))) - y
            for i in features:
                old = n.get(i, 0.0)
                sigma = ((old + g * g) ** 0.5 - old**0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], old + g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * b
            bn += g * g
    return {i: weight(i) for i in z if weight(i)}, -bz / ((beta + bn**0.5) / alpha)


def test_fit_equals_plain_ftrl(spark):
    docs, labels, _ = corpus(spark, 400)
    rows = toxicity.training_rows(docs, labels, "toxic", 5, 0, 300)
    at, weights, bias = toxicity.fit(rows)
    data = []
    for r in rows.orderBy("h").collect():
        found = gram_features([r["text"].encode()], toxicity.BITS)
        data.append((sorted(set(found[1].tolist())), r["y"]))
    want, want_bias = plain_ftrl(data, 4)
    assert dict(zip(at.tolist(), weights.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(want_bias) and len(want) > 3


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_risk_slopes_are_the_gradient(prior):
    rng = np.random.default_rng(2)
    fp, fu = rng.normal(size=7) + 1, rng.normal(size=9)
    loss = lambda x: np.log1p(np.exp(-x))
    rest = lambda a, b: loss(-b).mean() - prior * loss(-a).mean()
    goal = (lambda a, b: prior * loss(a).mean() + rest(a, b)) if rest(fp, fu) >= 0 else (lambda a, b: -rest(a, b))
    p, u = quality.risk_slopes(fp, fu, prior)
    for k in range(16):
        step = np.zeros(16)
        step[k] = 1e-6
        slope = (goal(fp + step[:7], fu + step[7:]) - goal(fp - step[:7], fu - step[7:])) / 2e-6
        assert slope == pytest.approx([*p, *u][k], abs=1e-6)


def test_prior_and_cut_by_plain_search():
    rng = np.random.default_rng(3)
    positive, unlabelled = rng.normal(2, 1, 4000).round(2), np.concatenate([rng.normal(2, 1, 3000), rng.normal(-2, 1, 2000)]).round(2)
    assert quality.class_prior(positive, unlabelled) == pytest.approx(0.6, abs=0.05)
    at = sorted({*positive.tolist(), *unlabelled.tolist()})
    risk = {c: 0.6 * (positive < c).mean() + max(0, (unlabelled >= c).mean() - 0.6 * (positive >= c).mean()) for c in at}
    cut = quality.risk_cut(positive, unlabelled, 0.6)
    above = min(c for c in at if c >= cut)
    assert risk[above] == pytest.approx(min(risk.values()), abs=1e-9)


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_repeated_ids_are_one_row_of_the_fit(spark, run):
    docs, labels, _ = corpus(spark, 300)
    one = docs.where("doc_id = 1")
    many = docs
    for _ in range(3):
        many = many.unionByName(one)
    got, want = ({r["doc_id"]: r["score"] for r in run(d, labels).collect()} for d in (many, docs))
    assert got == pytest.approx(want)


def test_accepted_keeps_all_without_labels(spark):
    docs, labels, _ = corpus(spark, 60)
    assert toxicity.accepted(docs, labels.limit(0)).count() == 60
