"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, jaccard, langid, licences, manifest, mixing, passages, pii, toxicity, vectors, warc, wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": jaccard.op1,
        "op2_pii_surrogates": pii.op2,
        "op3_licence_scan": licences.op3,
        "op4_benchmark_decontamination": decontaminate.op4,
        "op5_source_mixing": mixing.op5,
        "op6_language_id": langid.op6,
        "op7_embedding_near_dedup": vectors.op7,
        "op8_substring_dedup": passages.op8,
        "op9_toxicity": toxicity.op9,
        "op10_html_extraction": wrappers.op10,
        "op11_warc_revisits": warc.op11,
        "op12_merkle_manifest": manifest.op12,
        "op13_conversation_repair": conversations.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": jaccard.OP1_SQL,
        "op4_benchmark_decontamination": decontaminate.OP4_SQL,
        "op5_source_mixing": mixing.OP5_SQL,
        "op7_embedding_near_dedup": vectors.OP7_SQL,
        "op11_warc_revisits": warc.OP11_SQL,
        "op12_merkle_manifest": manifest.OP12_SQL,
        "op13_conversation_repair": conversations.OP13_SQL,
    }
