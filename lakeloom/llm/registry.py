"""The driver queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, chunking, language_id, mixing, near_duplicates, quality_rules, sentence_pieces, token_counts, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_quality_rules": quality_rules.query,
        "op2_chat_format": chat_format.query,
        "op3_token_counts": token_counts.query,
        "op4_media_chunks": chunking.query,
        "op5_toxicity": toxicity.query,
        "op6_sentence_pieces": sentence_pieces.query,
        "op7_url_filter": url_filter.query,
        "op8_language_id": language_id.query,
        "op9_ngram_jaccard_join": near_duplicates.query,
        "op10_source_mixing": mixing.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.oracle(), "op2_chat_format": chat_format.ORACLE, "op9_ngram_jaccard_join": near_duplicates.ORACLE}
