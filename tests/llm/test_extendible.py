"""Shards against SQL, their limit, and hot keys."""

import duckdb
import pytest
from conftest import ODD
from pyspark.sql import functions as F

from tidemark.llm import extendible as X

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("limit", [2_000, 20_000, 200_000, 1 << 30])
def test_equals_sql(spark, limit):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(X.oracle(limit)).fetchall()
    got = X.query(spark.read.parquet(f"{SMALL}/documents.parquet"), limit).select("doc_id", *X.ADDED).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r.shard for r in got}) >= (2 if limit < 200_000 else 1)


def check(got, limit):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for shard, rows in by.items():
        size = sum(len((r.text or "").encode()) for r in rows)
        assert size == rows[0].shard_bytes and len(rows) == rows[0].shard_docs and len(shard) == rows[0].depth
        assert size <= limit or len(rows) == 1
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    return by


def test_hot_keys_and_equal_rows_split(spark, documents):
    rows = [*ODD, *[(5, "same text in one row after the other")] * 300, *[(6, f"same id {k}") for k in range(200)], (77, "y" * 5000)]
    docs = documents(rows).withColumn("shard", F.lit("clash")).withColumn("cell", F.lit(1)).withColumn("_bits", F.lit("mine"))
    assert {r._bits for r in X.sharded(docs.limit(3)).collect()} == {"mine"}
    got = X.sharded(docs, 1000).collect()
    assert len(got) == len(rows)
    by = check(got, 1000)
    assert max(map(len, by)) > 120 and by


def test_empty_and_one_shard(documents):
    assert X.sharded(documents(ODD).limit(0)).count() == 0
    assert {r.shard for r in X.query(documents(ODD)).collect()} == {""}


def test_write(documents, tmp_path):
    X.write(documents(ODD), f"{tmp_path}/out", 30_000)
    back = documents([]).sparkSession.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(ODD)
    check(back.collect(), 30_000)
