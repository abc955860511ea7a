"""The corpus queries and their SQL, by the names under which the entry module registers them."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import ann, bpe, decontaminate, jaccard, line_dedup, pii, quality, sharding, toxicity, warc

QUERIES = {
    "op1_projection_forest": ann.op1,
    "op2_feistel_sharding": sharding.op2,
    "op3_fuzzy_line_dedup": line_dedup.op3,
    "op4_merkle_fixity": warc.op4,
    "op5_benchmark_decontamination": decontaminate.op5,
    "op6_compression_toxicity": toxicity.op6,
    "op7_quality_rules": quality.op7,
    "op8_pii_pseudonyms": pii.op8,
    "op9_byte_bpe": bpe.op9,
    "op10_jaccard_join": jaccard.op10,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op4_merkle_fixity": warc.OP4_SQL,
    "op5_benchmark_decontamination": decontaminate.OP5_SQL,
}
