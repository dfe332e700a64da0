"""Near-dedup against all pairs, and the pipeline's stages against plain restatements of each."""

import hashlib
import random

import brute
import corpus_pipeline
import public_tokenizers
import pytest
from conftest import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import near_dedup as N
from tidemark.llm import quality_rules

SMALL = "/root/testdata/sf0.001"
RANDOM = random.Random(4)


def kept_of(docs, similarity=0.8):
    """Ids that stay: components of all pairs by exact Jaccard similarity of five-word shingles."""
    sets = []
    for _, t in docs:
        w = brute.WORD.findall(brute.lower(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {None})
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= similarity * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    best = {}
    for k, (i, _) in enumerate(docs):
        best.setdefault(find(k), []).append((i is None, i or 0))
    return sorted(min(v) for v in best.values())


def near_copies(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    out, k = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 8, 40, 200, 600]))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = word()
            out.append((k, " ".join(copy)))
            k += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("shard", [N.SHARD, 3])
@pytest.mark.parametrize("kind", ["odd", "copies", "family", "empty", "table"])
def test_near_dedup_equals_all_pairs(spark, documents, monkeypatch, kind, shard):
    monkeypatch.setattr(N, "SHARD", shard)
    base = [f"w{RANDOM.randrange(10**6)}" for _ in range(300)]
    family = [(k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(60)]
    rows = {"odd": ODD, "copies": near_copies(60), "family": family, "empty": [],
            "table": [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]}[kind]
    got = N.near_dedup(documents(rows).withColumns({"digest": F.lit("clash"), "_digest": F.lit("clash"), "_keep": F.lit(1)}))
    assert got.columns[-3:] == ["digest", "_digest", "_keep"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == kept_of(rows)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    bench = [(r.item_id, " ".join(r.text.lower().split())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = docs.collect(), out.collect()
        ids = sorted(r.doc_id for r in after)
        pairs = [(r.doc_id, r.text) for r in before]
        if k < 4:
            assert out.columns == names
        if name == "quality_rules":
            assert ids == sorted(r.doc_id for r in quality_rules.query(docs).where("kept").collect()) and 0 < len(ids) < len(before)
        elif name == "line_dedup":
            want = {i: h for i, _, _, h in brute.line_dedup(pairs)}
            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after} == want
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "simhash_near_dedup":
            assert [(False, i) for i in ids] == kept_of(pairs)
        elif name == "benchmark_decontamination":
            assert ids == sorted(i for i, t in pairs if not any(x in " ".join(t.lower().split()) for _, x in bench))
        else:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = {i: t.encode(x, add_special_tokens=False).ids for i, x in pairs}
            assert {r.doc_id: r.ids for r in after} == want
            assert {r.doc_id: r.decoded_sha256 for r in after} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in pairs}
        docs = out


@pytest.mark.parametrize("rows", [[], ODD])
def test_run_on_odd_tables(spark, documents, tmp_path, rows):
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) <= len(rows)


def test_hash_orders_are_independent():
    """60,000 pairs of similarity 0.8: 0.15 are expected to share no minimum (one product for all orders: 6.6)."""
    import numpy as np

    from tidemark.llm.near_dedup import prints_of

    rng, missed = np.random.default_rng(11), 0
    for _ in range(60_000):
        s = rng.integers(0, 2**64, 60, dtype=np.uint64)
        missed += not set(zip(range(8), prints_of(s[:54])[1])) & set(zip(range(8), prints_of(s[6:])[1]))
    assert missed <= 1
