"""Clashing columns, empty tables and ties of the token operators and of every stage of the pipeline."""

import corpus_pipeline
import pytest
from conftest import ODD
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, distinct_bpe, katz, rans, simhash, turn_trie

CLASH = ("block", "shard", "seq", "ids", "words", "tokens", "digest", "task", "key", "label", "score", "row", "_digest", "n_lines_", "bucket")
#: Each text under an id of its own and twice under one, so that there are ties everywhere.
TIED = [*ODD, (3, ODD[3][1]), (20, "b a"), (21, "a b"), (22, "a b")]


def clashing(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("op", [rans, distinct_bpe, katz, simhash])
def test_clashing_columns_change_nothing(documents, op):
    docs = documents(TIED)
    assert rows(op.query(clashing(docs))) == rows(op.query(docs))


@pytest.mark.parametrize("op", [rans, distinct_bpe, katz, simhash])
def test_empty_tables_give_no_row(documents, op):
    assert rows(op.query(documents(TIED).limit(0))) == []


def test_stages_keep_clashing_columns(spark, documents, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (None, None)], "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(TIED)
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        plain, clash = step(spark, docs, str(tmp_path)), step(spark, clashing(docs), str(tmp_path))
        if k < 4:
            assert clash.columns == [*docs.columns, *CLASH], name
            assert {tuple(r[c] for c in CLASH) for r in clash.collect()} <= {tuple(range(len(CLASH)))}
        assert rows(clash.select(plain.columns)) == rows(plain), name
        assert step(spark, clashing(docs).limit(0), str(tmp_path)).count() == 0, name


def test_run_with_clashing_columns(spark, documents, tmp_path):
    spark.createDataFrame([(1, "nothing of this is there at all")], "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    clashing(documents(TIED)).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and 0 < out.count() <= len(TIED)


def test_blocks_of_items_one_after_the_other(spark, documents, monkeypatch):
    """Many small blocks of items clean like one."""
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["one two three four five six", "ten chars é", "A long enough line", "never there at all"])], "item_id LONG, text STRING")
    want = rows(decontaminate.clean(documents(TIED), bench))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 5)
    assert rows(decontaminate.clean(documents(TIED), bench)) == want and len(want) < len(TIED)


def test_trie_ignores_other_columns(spark):
    rows_ = [(c, t, "user", f"t{t % 3}") for c in range(7) for t in range(4)]
    df = spark.createDataFrame(rows_, "conv_id LONG, turn LONG, role STRING, text STRING")
    assert rows(turn_trie.query(clashing(df).withColumns({"part": F.lit(1), "pos": F.lit("x"), "seq": F.lit(2), "h": F.lit(3)}))) == rows(turn_trie.query(df))
