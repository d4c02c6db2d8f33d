"""Encoder, packing and token files against plain encoding, document by document."""

import random
import zlib

import numpy as np
import pytest
from tidemark.llm import packing, tokens, wavelet
from tidemark.llm.tokens import Encoder, default_path

HARD = ["dogs' x", "éa… b!", "x_ y_- (z) a’s", "9.9, a9!", "", " ", "a", "  a  b ", "a\n b", "a\n\nb  c", "don't stop's", " x", "x ", "　a", "a\xa0 b", "a\x85 b", "tab\tx \t y", "x<|endoftext|> y", "é ü  z", "日本 語", "1 2,3 \r\n", "long " * 5000]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoder_equals_library(plain):
    rng = random.Random(1)
    alphabet = ["a", "B", "'s", " ", "  ", "\n", "\t", "9", "é", ",", "\xa0", "日", " ", "<|endoftext|>"]
    cases = HARD + ["".join(rng.choices(alphabet, weights=[5, 3, 1, 8, 1, 1, 1, 2, 1, 2, 1, 1, 1, 1], k=rng.randrange(40))) for _ in range(3000)]
    enc = Encoder(most=50)
    for i in range(0, len(cases), 100):
        got = enc.encode(cases[i : i + 100])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain(x) for x in cases[i : i + 100]]


def test_encoder_sends_a_word_to_the_library_once_whatever_surrounds_it():
    words = [f"w{chr(97 + i)}{chr(97 + k)}" for i in range(20) for k in range(20)]
    texts = [f"{a}.\n{b}" + "$" * (i % 7) for i, a in enumerate(words) for b in words[:50]]
    enc, sent = Encoder(), []
    library, enc.tokenizer = enc.tokenizer, type("Counting", (), {"encode_batch_fast": lambda _, some, **k: sent.extend(some) or library.encode_batch_fast(some, **k)})()
    got = enc.encode(texts)
    assert sum(map(len, sent)) < 10 * len(words)
    assert [x.tolist() for x in map(lambda b: np.frombuffer(b, "<u4"), got[::97])] == [library.encode(x, add_special_tokens=False).ids for x in texts[::97]]


def test_encoder_among_all_kinds_of_characters(plain):
    rng = random.Random(4)
    odd = [chr(c) for c in [*range(0x180), 0x301, 0x3B1, 0x416, 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0x3042, 0x4E00, 0xFEFF, 0x1F600]]
    cases = [x for c in odd for x in (f"a{c} b", f"a {c}b", f"a\n{c}1", f"{c}\nb", f"'{c}a.{c}9", f"{c}  {c}")]
    cases += ["".join(rng.choices([*odd, *" \n'.a9s" * 40], k=rng.randrange(60))) for _ in range(3000)]
    got = Encoder(most=500).encode(cases)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain(x) for x in cases]


def test_encoder_cuts_long_texts(plain, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 100)
    cases = ["".join(random.Random(i).choices(["word", " ", " other", "\n", ".", "  ", "é"], k=300)) for i in range(50)] + ["x" * 500, "a b\0 " * 200, "a <|endoftext|>b " * 100]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder().encode(cases)] == [plain(x) for x in cases]


def test_encoder_of_another_build_sends_texts_whole(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_file(default_path())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)
    other.save(str(tmp_path / "t.json"))
    cases = ["a b", "x.\ny z", "", "dog's"]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(str(tmp_path / "t.json")).encode(cases)] == [other.encode(x, add_special_tokens=False).ids for x in cases]


def test_piece_lengths():
    assert packing.piece_lengths(2 * 1024 + 5) == [1024, 1024, 4, 1]
    assert packing.piece_lengths(0) == [] and packing.piece_lengths(1024) == [1024]
    with pytest.raises(ValueError):
        packing.piece_lengths(3, 100)


def docs(spark, texts):
    return spark.createDataFrame([(i * 3 % 31, x, "x", i) for i, x in enumerate(texts)], "doc_id long, text string, length string, start int")


def test_pack_covers_every_token_once(spark, plain):
    texts = [*HARD, None, "word " * 1500, "a", "a"]
    rows = packing.pack(docs(spark, texts), with_ids=True).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert all(r["offset"] == 0 and r["length"] in {1 << k for k in range(11)} and len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    want = {}
    for i, x in enumerate(texts):
        want[i * 3 % 31] = plain(x) + [0]
    for doc, ids in want.items():
        own = sorted((r["start"], r["ids"], r["doc_tokens"]) for r in rows if r["doc_id"] == doc)
        assert np.frombuffer(b"".join(x for _, x, _ in own), "<u4").tolist() == ids
        assert all(n == len(ids) for _, _, n in own)
    lengths = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)


def test_wavelet_matrix_queries():
    rng = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 5), (511, 9), (512, 300), (5000, 50000)):
        a = rng.integers(0, top, n)
        m = wavelet.from_bytes(wavelet.write_shard(np.zeros(0), np.zeros(0, bool), np.zeros(0), a, 16)).matrix
        assert m.decode().tolist() == a.tolist()
        for i in rng.integers(0, max(n, 1), 20) if n else []:
            v = int(a[i])
            assert m.access(int(i)) == v and m.rank(v, int(i)) == int((a[:i] == v).sum())
            k = m.rank(v, int(i))
            assert m.select(v, k) == i and m.count(v) == int((a == v).sum())
        assert m.count(65535) == 0


def test_token_files_round_trip(spark, plain):
    texts = [*HARD, None]
    folder = wavelet.write_token_files(docs(spark, texts), shard_tokens=500)
    assert spark.read.parquet(f"{folder}/index").count() > 3
    rows = sorted(wavelet.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r["doc_id"])
    want, start = {i * 3 % 31: plain(x) + [2] for i, x in enumerate(texts)}, 0
    assert [r["doc_id"] for r in rows] == sorted(want)
    for r in rows:
        ids = np.array(want[r["doc_id"]], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)


def test_empty_table(spark):
    none = docs(spark, ["x"]).limit(0)
    assert packing.pack(none).count() == 0
    assert wavelet.read_token_files(spark, wavelet.write_token_files(none)).count() == 0


def test_token_files_keep_null_ids(spark, plain):
    rows = [(5, "a b"), (None, "null one"), (-(2**62), "c"), (2**62 + 1, "d"), (None, None), (2**62 + 2, "e")]
    folder = wavelet.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), shard_tokens=3)
    got = sorted(wavelet.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -(2**62), 5, 2**62 + 1, 2**62 + 2]
    want = sorted((str(i), np.array(plain(x) + [2], "<u4").tobytes()) for i, x in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want


def test_token_files_of_repeated_ids_and_a_long_text(spark, plain):
    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "word other " * 60_000)]
    folder = wavelet.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), shard_tokens=2)
    got = sorted(wavelet.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((i, np.array(plain(x) + [2], "<u4").tobytes()) for i, x in rows)


def test_a_query_opens_few_sections(tmp_path):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50_000, 2_000_000)
    blob = wavelet.write_shard(np.arange(4), np.ones(4, bool), np.full(4, 500_000), ids, 16)
    (tmp_path / "x.tmw").write_bytes(blob)
    opened = wavelet.open_file(f"file://{tmp_path}/x.tmw").matrix
    assert [opened.access(i) for i in (0, 1_234_567, 1_999_999)] == ids[[0, 1_234_567, 1_999_999]].tolist()
    asked = []
    few = wavelet.TokenFile(lambda at, size: asked.append(size) or blob[at : at + size])
    value = int(ids[777])
    assert few.matrix.count(value) == int((ids == value).sum()) and few.matrix.select(value, 0) == int(np.flatnonzero(ids == value)[0])
    assert sum(asked) < len(blob) * 0.7 and few.documents()[2].tolist() == [500_000] * 4
