"""Training-data operators. Nothing else in the library imports this subpackage.

The modules are imported here, so that a missing package shows when this one is imported.
"""

from __future__ import annotations

from . import chat, exact_dedup, knn, mixing, near_dedup, packing, secrets, sharding, substring_dedup, toxicity


def queries() -> dict:
    import corpus_pipeline  # it imports this package

    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_sharding": sharding.op3_sharding,
        "op4_knn": knn.op4_knn,
        "op5_secrets": secrets.op5_secrets,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_chat_format": chat.op8_chat_format,
        "op9_packing": packing.op9_packing,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op3_sharding": sharding.SQL, "op4_knn": knn.SQL, "op6_exact_dedup": exact_dedup.SQL, "op8_chat_format": chat.SQL}
