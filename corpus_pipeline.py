"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, tokens.

Every stage works on all rows that its predecessor kept, and its decisions take effect: rules and near-dedup remove
documents, line dedup removes lines (and sets ``n_chars`` to what is left), decontamination removes documents in which a
benchmark item is found, the last stage turns texts into ids and proves that they decode.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, distinct_bpe, line_dedup, near_dedup, quality_rules
from tidemark.llm.common import stage, table
from tidemark.session import prepare


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = line_dedup.dedup_lines(docs).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup.near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of every document."""
    prepare(spark)
    path = public_tokenizers.path(distinct_bpe.VOCABULARY)

    def each(doc, ids):
        text = distinct_bpe.decoded(ids.tolist(), distinct_bpe.pieces(path))
        return doc, len(ids), ids.astype("int32"), hashlib.sha256(text).hexdigest()

    return distinct_bpe.per_document(docs, each, "doc_id LONG, n_tokens LONG, ids ARRAY<INT>, decoded_sha256 STRING")


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("simhash_near_dedup", near), ("benchmark_decontamination", benchmark), ("bpe", tokens)]

#: EM, fingerprints and the tokenizer are not SQL; tests/llm compares each stage with a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written and read back before the next one starts."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
