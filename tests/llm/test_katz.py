"""The backoff model against one in dictionaries; sums to one; better than the base on held-out text."""

import brute
import numpy as np
import pytest
from conftest import ODD

from tidemark.llm import blocks, katz

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(params=["odd", "table", "empty", "untrained"])
def docs(request, spark, documents):
    return {"odd": lambda: documents(ODD), "empty": lambda: documents(ODD).limit(0), "table": lambda: spark.read.parquet(f"{SMALL}/documents.parquet"),
            "untrained": lambda: documents([(i, "some words here") for i in range(300) if katz.fold_of(i) == 1])}[request.param]()


def close(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-7, atol=2e-6)


@pytest.mark.parametrize("hot", [katz.HOT, 50])
def test_katz(docs, monkeypatch, hot):
    """Several blocks and shards, with and without histories that are spread over the shards."""
    monkeypatch.setattr(blocks, "SHARD_WORDS", 3000)
    monkeypatch.setattr(katz, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r[:5]) + (round(r[5], 6), round(r[6], 6)) for r in katz.query(docs, block_bytes=60_000).collect()]
    close(got, list(brute.Katz(rows, katz.good_turing).rows(rows)))


def test_probabilities_sum_to_one(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]
    model = brute.Katz(rows, katz.good_turing)
    assert abs(sum(map(model.low, model.uni)) + model.unknown - 1) < 1e-9
    for h in ["", "the", *list(model.uni)[:20], "never seen"]:
        assert abs(sum(model.p(h, w) for w in model.uni) + model.p(h, "never seen") - 1) < 1e-9


def test_discounts():
    assert np.allclose(katz.good_turing([0, 0, 0, 0, 0, 0, 0]), 1)
    d = katz.good_turing([0, 1000, 400, 220, 140, 100, 75])
    assert (d[1:6] < 1).all() and (d[1:6] > 0).all() and (np.diff(d[1:6]) > 0).all() and d[6] == 1
    assert (katz.good_turing([0, 10, 0, 0, 0, 0, 0])[1:6] < 1).all()


def test_held_out_text_is_likelier_than_under_the_base(spark):
    got = katz.query(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() and (got.score <= 0).all()
