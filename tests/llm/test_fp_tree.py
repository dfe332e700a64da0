"""The FP-tree search against scores of all documents and against SQL; hot copies, ties, small trees, slices."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from brute import lower
from conftest import ODD

from tidemark.llm import fp_tree as T

SMALL = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, top=50):
    words = [(i, TERM.findall(lower(t or ""))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, tokens = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in words:
            m = 50 + (50 * len(w) * n_docs) // tokens
            got = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * w.count(x)) // (1000 * w.count(x) + 20 * m))
                      for x in set(TERM.findall(lower(text or ""))) if x in w)
            if got > 0:
                scores.append((-got, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id LONG, text STRING, doc_id STRING")


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


ITEMS = [(1, "a long enough line, other WORDS here"), (2, None), (3, "..."), (4, "École normale; ten chars é 12,345"), (None, "one two three"), (5, "x"), (5, "words nobody holds qqq"), (6, "日本語のテキスト")]


@pytest.mark.parametrize("top,tree,leaf,limit", [(50, 8192, 128, 1 << 23), (2, 4, 1, 40), (3, 7, 2, 1)])
def test_odd_rows(spark, documents, top, tree, leaf, limit):
    assert rows(T.ranked(documents(ODD), items_of(spark, ITEMS), top, limit, tree, leaf)) == brute(ODD, ITEMS, top)


@pytest.mark.parametrize("top,tree,leaf", [(5, 64, 4), (10, 1000, 3)])
def test_copies_and_ties(spark, documents, top, tree, leaf):
    rng = random.Random(top)
    docs = [(k, " ".join(rng.choice("the of and to in that rare odd few".split()) for _ in range(rng.randrange(12)))) for k in range(150)]
    docs += [(1000 - k, "the same copy of rare words") for k in range(120)] + [(7, "the same copy of rare words"), (7, "of")]
    items = [(k, " ".join(rng.sample("the of and to in that rare odd few copy words same none".split(), 4))) for k in range(9)]
    assert rows(T.ranked(documents(docs), items_of(spark, items), top, 1 << 20, tree, leaf)) == brute(docs, items, top)


def test_empty(spark, documents):
    none = documents(ODD).limit(0)
    assert rows(T.query(none, items_of(spark, ITEMS))) == [] == rows(T.query(documents(ODD), items_of(spark, ITEMS).limit(0)))


def test_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    assert rows(T.query(*(spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark")))) == sorted(con.execute(T.oracle()).fetchall(), key=repr)


def test_long_texts_are_split_by_pieces(monkeypatch):
    monkeypatch.setattr(T, "PIECE", 7)
    text = "Abc déf-ghi  jk,lmno pqrstuvwxyz0123456789 a\x00b " * 30
    assert [w for part in T.terms_of(text.encode()) for w in part] == [w.encode() for w in TERM.findall(lower(text))]


def test_nodes_bound_and_prune():
    rng = np.random.default_rng(1)
    lens = rng.integers(1, 9, 600)
    terms = np.concatenate([np.sort(rng.choice(30, k, False, 1 / np.arange(1, 31) / (1 / np.arange(1, 31)).sum())) for k in lens])
    tfs, n = rng.integers(1, 4, len(terms)), rng.integers(5, 50, 600)
    items = T.Items([rng.choice(30, 6, False) for _ in range(12)], np.bincount(terms, minlength=30), 600, int(n.sum()))
    tree = T.Tree(items, n, lens, terms, tfs, 8)
    assert sorted((a, b) for a, b, kids in tree.nodes if kids is None) == sorted({(a, b) for a, b, kids in tree.nodes if kids is None})
    assert sum(b - a for a, b, kids in tree.nodes if kids is None) == 600
    seen = 0
    for k in range(12):
        every, best = T.Best(600), T.Best(3)
        tree.search(k, every, np.zeros(30, bool), np.arange(600), np.zeros(600, bool))
        seen += tree.search(k, best, np.zeros(30, bool), np.arange(600), np.zeros(600, bool))
        assert best.rows[0].tolist() == every.rows[0][:3].tolist() and best.rows[1].tolist() == every.rows[1][:3].tolist()
    assert seen < 12 * 600 * 0.8
