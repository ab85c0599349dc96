"""One thin query for each training-data operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import query_chat, query_embeddings, query_mixing, query_near, query_quality, query_rules, query_tokens, query_trie, query_urls, query_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": query_urls.op1_url_filters,
    "op2_token_counts": query_tokens.op2_token_counts,
    "op3_embedding_near_dedup": query_embeddings.op3_embedding_near_dedup,
    "op4_mixing_sources": query_mixing.op4_mixing_sources,
    "op5_quality_rules": query_rules.op5_quality_rules,
    "op6_sentencepiece": query_tokens.op6_sentencepiece,
    "op7_minhash_near_dedup": query_near.op7_minhash_near_dedup,
    "op8_quality_classifier": query_quality.op8_quality_classifier,
    "op9_chat_formatting": query_chat.op9_chat_formatting,
    "op10_token_output": query_tokens.op10_token_output,
    "op11_hard_negatives": query_vectors.op11_hard_negatives,
    "op12_exact_topk": query_vectors.op12_exact_topk,
    "op13_prefix_trie": query_trie.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": query_urls.OP1_SQL,
    "op4_mixing_sources": query_mixing.OP4_SQL,
    "op5_quality_rules": query_rules.OP5_SQL,
    "op9_chat_formatting": query_chat.OP9_SQL,
    "op11_hard_negatives": query_vectors.OP11_SQL,
    "op12_exact_topk": query_vectors.OP12_SQL,
    "op13_prefix_trie": query_trie.OP13_SQL,
}
