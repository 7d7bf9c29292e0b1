"""The queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.llm import ann, bpe, decontam, html_text, minhash, oracles, pii, secrets, sharding, substring_dedup, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_hnsw": ann.op2_hnsw,
        "op3_pii": pii.op3_pii,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_secrets": secrets.op6_secrets,
        "op7_bpe": bpe.op7_bpe,
        "op8_html": html_text.op8_html,
        "op9_sharding": sharding.op9_sharding,
        "op10_minhash": minhash.op10_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": oracles.OP1, "op4_decontamination": oracles.OP4, "op10_minhash": oracles.OP10}
