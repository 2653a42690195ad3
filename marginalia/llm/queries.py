"""Queries over this package's operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, cobuckets, decontaminate, graph_dedup, html_text, jaccard, langid, lm_score, sharding, toxicity, urls
from .common import table

def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_hilbert_sharding": lambda spark, d: sharding.op1_hilbert_sharding(table(spark, d, "documents")),
    "op2_bpe_trie": lambda spark, d: bpe.op2_bpe(table(spark, d, "documents"), vocabulary_path("byte_bpe_50k.json")),
    "op3_decontamination": lambda spark, d: decontaminate.op3_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op4_chat_formatting": lambda spark, d: chat.op4_chat_formatting(table(spark, d, "conversations")),
    "op5_graph_dedup": lambda spark, d: graph_dedup.op5_graph_dedup(table(spark, d, "embeddings")),
    "op6_jaccard_tiles": lambda spark, d: jaccard.op6_jaccard(table(spark, d, "documents")),
    "op7_lm_score": lambda spark, d: lm_score.op7_lm_score(table(spark, d, "documents")),
    "op8_html_templates": lambda spark, d: html_text.op8_html_text(table(spark, d, "pages")),
    "op9_url_filter": lambda spark, d: urls.op9_url_filter(table(spark, d, "pages")),
    "op11_token_alignment": lambda spark, d: alignment.op11_token_alignment(table(spark, d, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")),
    "op12_co_buckets": lambda spark, d: cobuckets.op12_co_buckets(table(spark, d, "sales"), table(spark, d, "sale_lines")),
    "op13_language_id": lambda spark, d: langid.op13_language_id(table(spark, d, "documents")),
    "op10_toxicity": lambda spark, d: toxicity.op10_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
}


def sql() -> dict[str, str]:
    return {"op4_chat_formatting": chat.OP4_SQL, "op5_graph_dedup": graph_dedup.OP5_SQL, "op6_jaccard_tiles": jaccard.OP6_SQL, "op7_lm_score": lm_score.OP7_SQL, "op9_url_filter": urls.op9_sql()}
