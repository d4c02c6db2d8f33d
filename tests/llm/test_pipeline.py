"""The pipeline's stages against plain versions, and what they must keep."""

import corpus_pipeline
import numpy as np
import pytest
from tidemark.llm import mixing

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 7)))) for _ in range(n))


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicate_stage(spark):
    rng = np.random.default_rng(0)
    a, b = words(rng, 300), words(rng, 300)
    docs = make(spark, [(5, a, "en", "x", 1), (3, a, "en", "y", 1), (9, b, "fr", None, 1), (9, b, "fr", None, 1), (1, "", "en", "x", 0), (2, None, "en", "x", 0), (7, "short text", "en", "x", 1)])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7, 9]


def test_suffix_stage(spark):
    rng = np.random.default_rng(1)
    passage, a, b = words(rng, 60), words(rng, 50), words(rng, 50)
    docs = make(spark, [(1, a + passage, "en", "x", 0), (2, passage + b, "de", None, 0), (3, passage, "en", "x", 0), (4, None, "en", "x", 0), (5, "é" * 200, "fr", "z", 0)])
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert got[1]["text"] == a + passage and got[2]["text"] == b and got[2]["lang"] == "de" and got[2]["source"] is None
    assert got[4]["text"] == "" and got[2]["n_chars"] == len(b) and got[5]["text"] in ("é", "éé") + ("é" * 49, "é" * 50, "é" * 51)


def plain_mix(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    """(source -> size, target) by resharing until nothing is above its cap."""
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return sizes, target


def test_mixing_against_plain(spark):
    rng = np.random.default_rng(2)
    rows = [(i, words(rng, int(rng.integers(0, 40))) or None, "en", [None, "b", "a", "é", "Z"][i % 5 if i % 2 else 1], 0) for i in range(300)]
    docs = make(spark, rows)
    sizes, target = plain_mix(rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 300
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) for r in own)
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    kept = corpus_pipeline.mix(spark, docs, SF).collect()
    for s in sizes:
        taken = sum(len((r["text"] or "").split()) for r in kept if r["source"] == s)
        assert abs(taken - target[s]) <= 40


def test_mixing_edges(spark):
    assert mixing.mix_sources(make(spark, [])).count() == 0
    rows = mixing.mix_sources(make(spark, [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "a b", "en", "a", 3), (1, "a b", "en", "a", 3)])).collect()
    assert len(rows) == 4 and sum(r["taken"] for r in rows) == 6
    odd = make(spark, [(1, "a b c", "en", "s", 5), (2, "d", "en", "t", 1)]).selectExpr("*", "7 AS size", "'k' AS key", "3 AS bucket", "1 AS epochs", "'h' AS text_hash", "2 AS place")
    assert {r["doc_id"]: r["size"] for r in mixing.mix_sources(odd).collect()} == {1: 3, 2: 1}
    assert mixing.mixed(odd).columns == odd.columns


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "x y", None, None, 3), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 20000, "en", "a", 100000), (3, " \n\t", "en", None, 3)]
    for _, stage in corpus_pipeline.STAGES:
        for docs in (make(spark, rows), make(spark, [])):
            found = stage(spark, docs, SF)
            assert found.columns == docs.columns or "sequence_id" in found.columns
            assert found.count() > 0 or not docs.take(1)


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and all(r["length"] in {1 << k for k in range(11)} for r in rows)
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_stages_keep_columns_of_any_name(spark):
    names = ["_key", "_id", "_times", "key", "row", "order", "times", "i", "h", "group", "node", "part", "block", "kind", "payload", "size", "bucket", "copies"]
    docs = make(spark, [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, "en", None, 0), (3, "d e f g", "de", "t", 7)])
    docs = docs.selectExpr("*", *(f"cast({i} as int) AS `{n}`" for i, n in enumerate(names)), "map('a', 1) AS held")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        for r in found.collect():
            assert [r[n] for n in names] == list(range(len(names))) and r["held"] == {"a": 1}


def test_rows_of_one_id_and_text_leave_the_same_one(spark):
    docs = make(spark, [(1, "a b c", lang, "s", 5) for lang in ("en", "de", "fr", None)])
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix):
        found = {tuple(r) for n in (1, 4) for r in stage(spark, docs.repartition(n), SF).collect()}
        assert len(found) == 1


def test_repeated_rows_are_mixed_in_any_number(spark):
    docs = make(spark, [(7, "a b", "en", "s", 0)] * 500 + [(i, "x y z", "en", "s", 0) for i in range(20)])
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 520 and sum(r["taken"] for r in got) == int(got[0]["target"]) and len({r["place"] for r in got}) == 520
