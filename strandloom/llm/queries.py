"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontaminate, language_id, near_dedup, packing, pii, quality_lines, repeats, sharding, token_counts, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_language_id": language_id.op2_language_id,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_shard_table": sharding.op4_shard_table,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_quality": quality_lines.op7_quality,
    "op8_pii": pii.op8_pii,
    "op9_repeats": repeats.op9_repeats,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {
    "op4_shard_table": sharding.oracle(),
}
