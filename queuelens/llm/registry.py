"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queuelens.llm import conversation_repair, licenses, media, mixing, near_vectors, ngram_join, packing, pii, quality, sharding, suffix_dedup, topk, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.query,
        "op2_pfair_mix": mixing.query,
        "op3_ngram_jaccard": ngram_join.query,
        "op4_lossless_webp": media.query,
        "op5_pii": pii.query,
        "op6_exact_top_k": topk.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_best_fit_pack": packing.query,
        "op9_histogram_sort_shards": sharding.query,
        "op10_license_scan": licenses.query,
        "op11_near_vectors": near_vectors.query,
        "op12_vector_codes": vector_codes.query,
        "op13_conversation_repair": conversation_repair.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": ngram_join.SQL, "op6_exact_top_k": topk.SQL, "op7_suffix_dedup": suffix_dedup.SQL, "op11_near_vectors": near_vectors.SQL, "op12_vector_codes": vector_codes.SQL, "op13_conversation_repair": conversation_repair.SQL}
