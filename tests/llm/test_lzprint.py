"""Fingerprints against a plain parse and plain set resemblance."""

import hashlib

import numpy as np
from tidemark.llm import lzprint


def phrases(data: bytes) -> set[bytes]:
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def test_parse_equals_plain():
    for data in (b"", b"a", b"aaaaaaaaaaaa", b"abababababa", "héllo wörld héllo".encode() * 9, bytes(range(256)) * 3):
        seen = set()
        lzprint.parse(data, seen, 0, len(data))
        assert seen == phrases(data)


def brute(rows):
    """(id, text) rows in descending order of id."""
    out = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = lzprint.sketch(text), lzprint.sketch(edited), lzprint.sketch(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.astype(">u4").tobytes().hex(), b.astype(">u4").tobytes().hex(), lzprint.likeness(a, b), lzprint.likeness(a, c)))
    return out


def test_table_equals_brute_force(spark):
    texts = ["", None, "x", "ab", "abc", "the cat sat on the mat " * 40, "日本語テキスト" * 30, "the cat sat on the hat " * 40, "z" * 30000]
    rows = [(i * 5 + 1, x) for i, x in enumerate(texts * 4)]
    got = lzprint.fingerprints(spark.createDataFrame([(i, x, "f") for i, x in rows], "doc_id long, text string, fingerprint string").repartition(3)).collect()
    want = brute([(i, x or "") for i, x in sorted(rows, reverse=True)])
    assert sorted(map(tuple, got)) == sorted(want)
    same = {r["n_chars"]: r["fingerprint"] for r in got if r["n_chars"] > 100}
    assert all(r["fingerprint"] == same[r["n_chars"]] or r["n_chars"] == 920 for r in got if r["n_chars"] > 100)


def test_sketch_estimates_resemblance():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    a = " ".join(rng.choice(words, 1500))
    b = a[: len(a) * 2 // 3] + " ".join(rng.choice(words, 500))
    x, y = phrases(a.encode()), phrases(b.encode())
    assert abs(lzprint.likeness(lzprint.sketch(a), lzprint.sketch(b)) - len(x & y) / len(x | y)) < 0.2
    assert lzprint.likeness(lzprint.sketch(""), lzprint.sketch("")) == 1 and lzprint.likeness(lzprint.sketch(""), lzprint.sketch("a")) == 0


def test_small_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert lzprint.fingerprints(make([])).count() == 0
    (one,) = lzprint.fingerprints(make([(4, "abcdef")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1
    assert lzprint.fingerprints(make([(1, "a"), (1, "a"), (1, "b"), (None, "q")])).count() == 4
