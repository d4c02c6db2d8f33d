"""One query for each operator and the pipeline, as the driver asks for them."""

import corpus_pipeline
from tidemark.llm import registry


def test_names():
    found = {int(n[2:].split("_")[0]) for n in registry.QUERIES}
    assert found == set(range(1, 11)) and len(registry.QUERIES) == 10
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_array", "mixing", "packing"]
