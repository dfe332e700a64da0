"""The queries of the subpackage and their SQL: thin views on the operators, each over whole tables."""

from __future__ import annotations

from . import compression_quality, decontaminate, distinct_bpe, extendible, fp_tree, html_labeller, katz, line_dedup, pii, quality_rules, rans, simhash, turn_trie
from .common import table

QUERIES = {
    "op1_rans": lambda spark, sf: rans.query(table(spark, sf, "documents")),
    "op2_html_labeller": lambda spark, sf: html_labeller.query(table(spark, sf, "pages")),
    "op3_line_dedup": lambda spark, sf: line_dedup.query(table(spark, sf, "documents")),
    "op4_compression_quality": lambda spark, sf: compression_quality.query(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op5_quality_rules": lambda spark, sf: quality_rules.query(table(spark, sf, "documents")),
    "op6_extendible_hashing": lambda spark, sf: extendible.query(table(spark, sf, "documents")),
    "op7_distinct_bpe": lambda spark, sf: distinct_bpe.query(table(spark, sf, "documents")),
    "op8_simhash_bktree": lambda spark, sf: simhash.query(table(spark, sf, "documents")),
    "op9_qgram_decontamination": lambda spark, sf: decontaminate.query(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op10_katz": lambda spark, sf: katz.query(table(spark, sf, "documents")),
    "op11_bootstrapped_contexts": lambda spark, sf: pii.query(table(spark, sf, "documents")),
    "op12_vertical_bitmaps": lambda spark, sf: turn_trie.query(table(spark, sf, "conversations")),
    "op13_document_fp_tree": lambda spark, sf: fp_tree.query(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
}
ORACLES: dict[str, str] = {"op6_extendible_hashing": extendible.oracle(), "op12_vertical_bitmaps": turn_trie.oracle(),
                           "op13_document_fp_tree": fp_tree.oracle()}
