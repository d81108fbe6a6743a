"""Registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

import corpus_pipeline

from . import embedding_dedup, html_text, jaccard_join, language_id, line_rules, mixing, packing, simple8b, substring_dedup, url_graph
from .common import table

QUERIES = {
    "op1_language_id": lambda spark, d: language_id.op1(table(spark, d, "documents")),
    "op2_url_graph": lambda spark, d: url_graph.op2(table(spark, d, "pages")),
    "op3_substring_dedup": lambda spark, d: substring_dedup.op3(table(spark, d, "documents")),
    "op4_line_rules": lambda spark, d: line_rules.op4(table(spark, d, "documents")),
    "op5_html_text": lambda spark, d: html_text.op5(table(spark, d, "pages")),
    "op6_jaccard_join": lambda spark, d: jaccard_join.op6(table(spark, d, "documents")),
    "op7_mixing": lambda spark, d: mixing.op7(table(spark, d, "documents")),
    "op8_packing": lambda spark, d: packing.op8(table(spark, d, "documents")),
    "op9_embedding_dedup": lambda spark, d: embedding_dedup.op9(table(spark, d, "embeddings")),
    "op10_simple8b": lambda spark, d: simple8b.op10(table(spark, d, "documents")),
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_url_graph": url_graph.ORACLE_SQL,
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_line_rules": line_rules.ORACLE_SQL,
    "op6_jaccard_join": jaccard_join.ORACLE_SQL,
    "op9_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
}
