"""Name -> query and name -> DuckDB oracle of the training-data operators."""

from __future__ import annotations

from . import ann, dedup, lm, lzprint, mixing, packing, quality, simhash, toxicity, wavelet

QUERIES: dict = {
    "op1_suffix_dedup": dedup.op1_suffix_dedup,
    "op2_pack": packing.op2_pack,
    "op3_lz_fingerprints": lzprint.op3_lz_fingerprints,
    "op4_simhash": simhash.op4_simhash,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_files": wavelet.op6_token_files,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_nearest": ann.op8_nearest,
    "op9_lm_scores": lm.op9_lm_scores,
    "op10_quality": quality.op10_quality,
}
ORACLES: dict[str, str] = {"op7_mix_sources": mixing.ORACLE}
