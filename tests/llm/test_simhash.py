"""SimHash fingerprints, links and components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from tidemark.llm import simhash
from tidemark.llm.components import components


def plain(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    n = max(1, len(words) - 3)
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > n)


def roots(fps, radius=4):
    label = list(range(len(fps)))
    change = True
    while change:
        change = False
        for i, x in enumerate(fps):
            for j, y in enumerate(fps):
                if (x ^ y).bit_count() <= radius and label[j] < label[i]:
                    label[i], change = label[j], True
    return label


TEXTS = ["", None, " \t\n", "One", "one two three", "A b C d", "a  b\tc\nd", "É é a b c", "the quick brown fox jumps over the lazy dog " * 30, "the quick brown fox jumps over the lazy dog " * 30 + "end", "x\x00y z w v", "word\xa0word a b c d e"]


def test_fingerprints_equal_plain():
    assert simhash.text_fingerprints([(x or "").encode() for x in TEXTS]).tolist() == [plain(x) for x in TEXTS]


@pytest.mark.parametrize("rows", [10, 3 << 20, 1 << 33])
def test_masks_miss_nothing(rows):
    rng = np.random.default_rng(5)
    masks = simhash.band_masks(rows, 4)
    for _ in range(500):
        flip = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
        assert any(not flip & m for m in masks)


@pytest.mark.parametrize("tile", [3, 512])
def test_tiles_equal_brute_force(monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = np.unique(np.array([int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 4))) for b in base for _ in range(9)], dtype=np.uint64))
    a, b = simhash.tile_links(fps, 4)
    label = list(range(len(fps)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        lo, hi = sorted((label[x], label[y]))
        label = [lo if v == hi else v for v in label]
    want = roots([int(x) for x in fps])
    assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want))
    half = len(fps) // 2
    a, b = simhash.tile_links(fps[:half], 4, fps[half:])
    near = {(i, j) for i in range(half) for j in range(half, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    assert {x for p in near for x in p} == set(a.tolist()) | set(b.tolist())


@pytest.mark.parametrize("rows", [8192, 7])
def test_table_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "TILE_ROWS", rows)
    rng = np.random.default_rng(9)
    texts = list(TEXTS)
    for _ in range(6):
        words = [f"w{k}" for k in rng.integers(0, 5000, 120)]
        for _ in range(8):
            w = list(words)
            w[int(rng.integers(0, 120))] = "edit"
            texts.append(" ".join(w))
    ids = [1000 - 7 * i for i in range(len(texts))]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts, ids, strict=True)), "doc_id long, text string, fp long")).collect()}
    fps = [plain(x) for x in texts]
    label = roots(fps)
    least = {}
    for i, v in zip(ids, label, strict=True):
        least[v] = min(i, least.get(v, i))
    assert got == {i: (f"{f:016x}", least[v]) for i, f, v in zip(ids, fps, label, strict=True)}


def test_edge_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.near_duplicates(make([])).count() == 0
    rows = simhash.near_duplicates(make([(3, "a"), (3, "a"), (None, "a"), (None, "b")])).collect()
    assert sorted(r["component_id"] is None for r in rows) == [False, False, False, True]


def test_components_of_long_and_wide_graphs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {k: 100 for k in range(100, 160)} | {500: 400, 400: 400}


def test_majority_equals_plain_counting():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    base = np.array([0, 1, 3, 258, 513, 1023, 1100])
    want = []
    for a, b in zip(base, [*base[1:], 3000], strict=True):
        want.append(sum(1 << j for j in range(64) if 2 * sum(int(x) >> j & 1 for x in hashes[a:b]) > b - a))
    assert simhash.majority(hashes, base).tolist() == want


def test_closest_links_keep_every_threshold():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, (4, 4), dtype=np.uint64)
    rows = []
    for b in base:
        for _ in range(20):
            w = [int(x) for x in b]
            for _ in range(int(rng.integers(0, 30))):
                w[int(rng.integers(0, 4))] ^= 1 << int(rng.integers(0, 64))
            rows.append(w)
    fps = np.array(rows, np.uint64)
    d = lambda i, j: sum((int(x) ^ int(y)).bit_count() for x, y in zip(fps[i], fps[j], strict=True))
    a, b = simhash.closest_links(fps, 50)

    def groups(pairs):
        label = list(range(len(fps)))
        for i, j in pairs:
            lo, hi = sorted((label[i], label[j]))
            label = [lo if x == hi else x for x in label]
        return label

    for most in (5, 20, 35, 50):
        full = groups([(i, j) for i in range(len(fps)) for j in range(i) if d(i, j) <= most])
        mine = groups([(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if d(i, j) <= most])
        assert len(set(zip(full, mine, strict=True))) == len(set(full)) == len(set(mine))


@pytest.mark.parametrize("rows", [2048, 6])
def test_similar_groups_follow_exact_resemblance(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "WIDE_ROWS", rows)
    rng = np.random.default_rng(12)
    docs, sets = [], []
    for g in range(12):
        words = [f"w{k}" for k in rng.integers(0, 100000, 200)]
        for edits in (0, 0, 1, 2, 3, 12, 30):
            w = list(words)
            for at in rng.choice(200, edits, replace=False):
                w[int(at)] = f"x{rng.integers(0, 10**9)}"
            docs.append((len(docs), " ".join(w)))
            sets.append({tuple(w[i : i + 5]) for i in range(196)})
    docs += [(len(docs), ""), (len(docs) + 1, None), (len(docs) + 2, "a b")]
    sets += [set(), set(), {("a", "b")}]
    got = {r["key"]: r["group"] for r in simhash.similar_groups(spark.createDataFrame(docs, "k long, text string"), "k").collect()}
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    assert got == dict(enumerate(label))


def groups_of(spark, texts):
    rows = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k").collect()
    return [g for _, g in sorted((r["key"], r["group"]) for r in rows)]


def test_copies_that_repeat_a_line_more_often_are_near(spark):
    body = " ".join(f"w{i}" for i in range(300))
    line = " ".join(f"r{i}" for i in range(14))
    texts = [f"{body} {line}"] + [" ".join([body, *[line] * n]) for n in (8, 30)]
    assert groups_of(spark, texts) == [0, 0, 0]


def test_texts_of_one_fingerprint_and_other_shingles_stay_apart(spark):
    one, two = ("same " * 3000 + " ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    line = "the quick brown fox jumps over a lazy dog " * 1000
    three, four = (line + " ".join(f"{x}{i}" for i in range(800)) for x in "cd")
    assert groups_of(spark, [one, two, three, four, one + " b0", three]) == [0, 1, 2, 3, 0, 2]


def brute_groups(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (x.split() for x in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def test_links_that_a_forest_of_closer_candidates_leaves_out_count(spark):
    rng = np.random.default_rng(30)
    texts = []
    for g in range(20):
        for k in [40, 40, *[41] * 10]:
            w = [f"g{g}w{i}" for i in range(400)]
            w[100 : 100 + k] = [f"x{rng.integers(0, 10**9)}" for _ in range(k)]
            texts.append(" ".join(w))
    want = [12 * g + (k if k != 1 else 0) for g in range(20) for k in range(12)]
    assert brute_groups(texts) == want
    assert groups_of(spark, texts) == want


@pytest.mark.parametrize("rows", [2048, 6])
def test_dense_groups_near_the_threshold_lose_no_link(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "WIDE_ROWS", rows)
    rng = np.random.default_rng(21)
    texts = []
    for g in range(30):
        for _ in range(12):
            w = [f"g{g}w{k}" for k in range(200)]
            at = int(rng.integers(0, 200))
            for k in range(at, at + int(rng.integers(14, 28))):
                w[k % 200] = f"x{rng.integers(0, 10**9)}"
            texts.append(" ".join(w))
    want = brute_groups(texts)
    assert 30 < len(set(want)) < len(texts)
    assert groups_of(spark, texts) == want


def test_pairs_at_the_threshold_and_short_texts_are_all_found(spark):
    texts = []
    for g in range(400):
        common = [f"g{g}w{k}" for k in range(84)]
        texts += [" ".join([*common, *(f"a{g}x{k}" for k in range(10))]), " ".join([*common, *(f"b{g}y{k}" for k in range(10))])]
    for g in range(200):
        short = [f"s{g}w{k}" for k in range(8)]
        texts += [" ".join(short), " ".join([*short, "end"]), " ".join(["front", *short, "x"])]
    texts.append("the same line in all of them")
    want = [i // 2 * 2 for i in range(800)] + [800 + i // 3 * 3 + (i % 3 == 2) * 2 for i in range(600)] + [1400]
    assert groups_of(spark, texts) == want


@pytest.mark.parametrize("hot", [0, 40])
def test_filters_on_sets_miss_nothing(hot):
    rng = np.random.default_rng(8)
    frequent = np.sort(rng.integers(0, 2**64, hot, dtype=np.uint64))
    for n in [*range(1, 40), 300, 3000]:
        most = n // 9 if n > 8 else n // 5
        for _ in range(5):
            x = np.unique(np.concatenate([rng.integers(0, 2**64, n, dtype=np.uint64), frequent]))
            y = np.unique(np.concatenate([x[most:], rng.integers(0, 2**64, most, dtype=np.uint64)]))
            same = len(np.intersect1d(x, y))
            if same < 0.8 * (len(x) + len(y) - same):
                continue
            base = np.array([0, len(x)])
            rare, need = simhash.rare_first(np.concatenate([x, y]), base, 0.8, frequent, np.full(hot, 9))
            assert set(rare[: need[0]].tolist()) & set(rare[need[0] :].tolist())
            bits = simhash.parity_bits(np.concatenate([x, y]), base)
            assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(x) + len(y) - 2 * same
            assert len(simhash.closest_links(bits, 64 * simhash.WIDE, np.array([len(x), len(y)]), 0.8)[0]) == 1


def test_fine_bits_miss_nothing_and_tell_long_sets_apart():
    rng = np.random.default_rng(9)
    sets, want = [], set()
    for n in (900, 1020, 1024, 1025, 2040, 2049, 5000, 9000, 40_000):
        one = rng.integers(0, 2**64, n, dtype=np.uint64)
        part = n // 10
        both = [one, np.concatenate([one[part:], rng.integers(0, 2**64, part, dtype=np.uint64)]), one[n // 5 :], rng.integers(0, 2**64, n, dtype=np.uint64)]
        want |= {(len(sets), len(sets) + 1), (len(sets), len(sets) + 2)}
        sets += [np.unique(x) for x in both]
    base = np.cumsum([0, *map(len, sets)])[:-1]
    fine = simhash.fine_bits(np.concatenate(sets), base)
    for row, own in zip(fine, sets, strict=True):
        assert len(row) * 64 >= len(own) and (len(row) == simhash.WIDE or len(row) * 32 < len(own))
        plain = simhash.parity_bits(own, np.array([0]))
        assert (simhash.folded(row[None], simhash.WIDE) == plain).all()
    a, b = simhash.fine_links([x.tobytes() for x in fine], np.array([len(x) for x in sets]), 0.8)
    label = list(range(len(sets)))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        lo, hi = sorted((label[i], label[j]))
        label = [lo if x == hi else x for x in label]
    assert all(label[i] == label[j] for i, j in want)
    alone = [i for i in range(3, len(sets), 4) if len(sets[i]) > 4096]
    assert all(label.count(label[i]) == 1 for i in alone)


@pytest.mark.parametrize("rows", [2048, 4])
def test_long_texts_that_share_a_passage_follow_exact_resemblance(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "WIDE_ROWS", rows)
    rng = np.random.default_rng(31)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for g in range(8):
        n = int(rng.integers(900, 6000))
        words = [f"g{g}w{i}" for i in range(n)]
        for share in (0, 0.02, 0.1, 0.105, 0.12, 0.2):
            k = int(share * n)
            texts.append(" ".join([*passage, *words[k:], *(f"x{rng.integers(0, 10**9)}" for _ in range(k))]))
        texts.append(" ".join([*words[: int(0.82 * n)], *passage]))
    texts.append(" ".join(passage))
    assert groups_of(spark, texts) == brute_groups(texts)
