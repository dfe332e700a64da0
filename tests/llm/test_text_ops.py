"""Line dedup, quality rules and SimHash against plain restatements, on odd rows and on a whole small table."""

import brute
import numpy as np
import pytest
from conftest import ODD

from tidemark.llm import line_dedup, quality_rules, simhash
from tidemark.llm.line_dedup import CuckooFilter, LineDedup

SMALL = "/root/testdata/sf0.001"


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["odd", "table", "empty"])
def docs(request, spark, documents):
    return {"odd": lambda: documents(ODD), "table": lambda: small(spark), "empty": lambda: documents(ODD).limit(0)}[request.param]()


def test_line_dedup(docs):
    got = rows(line_dedup.query(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(brute.line_dedup(pairs(docs)), key=repr)


def test_quality_base(docs):
    got = rows(quality_rules.query(docs), "doc_id", *quality_rules.STATS[:1], *quality_rules.STATS[1:], "base_failed")
    assert got == sorted(brute.quality_base(pairs(docs)), key=repr)


def test_simhash(docs):
    got = rows(simhash.query(docs), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute.simhash(pairs(docs)), key=repr)


def test_line_dedup_is_reversible(spark, documents):
    held, more = small(spark), documents([(100_000 + k, t) for k, (_, t) in enumerate(pairs(small(spark))[:60])] + [(1, "A line of its own kind\nshort")])
    state = LineDedup.build(held)
    want = rows(state.counts, "key", "refs", "first_doc")
    grown = state.insert(more)
    assert rows(grown.counts, "key", "refs", "first_doc") == rows(LineDedup.build(held.unionByName(more)).counts, "key", "refs", "first_doc")
    back = grown.delete(more.where("doc_id >= 100000"))
    again = rows(back.counts, "key", "refs", "first_doc")
    assert [r for r in again if r not in want] == [r for r in again if r[2] == 1 and r[1] == 1 and r not in want] and set(want) <= set(again)
    drop = lambda s: sorted((r.doc_id, sorted(r["keys"])) for r in s.dropped().collect())
    assert drop(back) == drop(state) and drop(grown) != drop(state)


def test_cuckoo_filter_keeps_and_forgets():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, (40_000, 2)).astype(np.uint64)
    made = CuckooFilter.build(keys[:20_000])
    assert made.may_hold(keys[:20_000]).all() and made.may_hold(keys[20_000:]).mean() < 1e-3
    made.remove(keys[:5_000])
    made = CuckooFilter.from_bytes(made.to_bytes())
    assert made.may_hold(keys[5_000:20_000]).all() and made.may_hold(keys[:5_000]).mean() < 1e-2


def test_clashing_columns(documents):
    from pyspark.sql import functions as F

    docs = documents(ODD).withColumns({"n_lines": F.lit("x"), "fp": F.lit(1), "keys": F.lit(2), "votes": F.lit(3), "key": F.lit(4), "_doc": F.lit(5), "_lost": F.lit(6)})
    assert line_dedup.dedup_lines(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "keys", "votes", "key", "_doc", "_lost", "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(docs).count() == len(ODD) == simhash.query(docs).count() == quality_rules.query(docs).count()
    assert quality_rules.filter_documents(docs).columns == docs.columns


def test_rules_agree_with_labels_they_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.query(spark.read.parquet(f"{sf}/documents.parquet")).drop("quality").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    judged = got[~got.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.97 and judged[judged.quality == 0].kept.mean() < 0.05


def test_rules_posterior_is_a_probability_on_odd_rows(documents):
    got = quality_rules.query(documents(ODD)).collect()
    assert all(0 <= r.quality <= 1 and not (r.kept and r.base_failed) for r in got)


def test_bk_forest_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (2000, 3)).astype(np.uint64)
    values = np.unique(base[rng.integers(0, 40, 2000)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    shard = np.arange(len(values)) % 3
    got = {frozenset(p) for a, b in simhash.BKForest(shard, values).links(4) for p in zip(a.tolist(), b.tolist())}
    d = simhash.distance(values[:, None], values[None, :])
    want = {frozenset((i, j)) for i, j in zip(*np.nonzero((d <= 4) & (shard[:, None] == shard[None, :]))) if i < j}
    assert got == want


def test_hot_shards_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_LIMIT", 3)
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**62, 5)
    values = sorted({int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in rng.integers(0, 62, (40, 2))})
    got = simhash.linked(spark.createDataFrame([(v,) for v in values], "fp LONG"), 2).collect()
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in got:
        assert (r.a ^ r.b).bit_count() <= 64
        x, y = find(r.a), find(r.b)
        up[max(x, y)] = min(x, y)
    want = dict(up)
    up = {v: v for v in values}
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    mine = {v: find(v) for v in values}
    up = want
    assert {v: find(v) for v in values} == mine


def test_variety_is_judged_at_every_length():
    """Five thousand words from forty are as poor as two hundred from four; long running text is not."""
    rng = np.random.default_rng(0)
    poor = [" ".join(f"w{k}" for k in rng.integers(0, kinds, n)).encode() for n, kinds in ((200, 4), (5000, 40), (60_000, 90))]
    rich = [" ".join(f"w{k}" for k in rng.zipf(1.3, n)).encode() for n in (200, 5000, 60_000)]
    at = [r[1] for r in quality_rules._RULES].index("variety")
    votes = quality_rules._digits(quality_rules.judged(poor + rich)["votes"])[:, at]
    assert votes[:3].tolist() == [1, 1, 1] and votes[3:].tolist() == [2, 2, 2]
