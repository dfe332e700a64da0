"""Decontamination against the full edit-distance table, and on planted passages."""

import random

import brute
import numpy as np
from conftest import ODD
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D

RANDOM = random.Random(8)
WORDS = ["the", "and", "tion", "ing", "there", "hand", "onst", "er", "blea", "thou", "école", "straße", "日本"]


def prose(n):
    return " ".join(RANDOM.choice(WORDS) for _ in range(n))


def edited(text, edits):
    out = list(text)
    for _ in range(edits):
        at = RANDOM.randrange(len(out))
        kind = RANDOM.randrange(3)
        if kind == 0:
            out[at] = RANDOM.choice("xyz ")
        elif kind == 1:
            out.insert(at, RANDOM.choice("xyz"))
        else:
            del out[at]
    return "".join(out)


def test_matches_equal_the_full_table(spark, documents):
    items = [(k, prose(RANDOM.randint(8, 25))) for k in range(12)] + [(50, "short"), (51, "tiny item here"), (None, None), (52, "")]
    rows = []
    for k in range(60):
        item = RANDOM.choice(items[:12])[1]
        body = [prose(RANDOM.randint(0, 30)), edited(item, RANDOM.choice([0, 1, len(item) // 12, len(item) // 10, len(item) // 9, len(item) // 7])), prose(RANDOM.randint(0, 30))]
        rows.append((k, " ".join(body) if k % 5 else prose(40)))
    rows += [(100, items[3][1].upper().replace(" ", " \n\t")), (101, "tiny item here"), (102, None), (103, "")]
    got = D.query(documents(rows), spark.createDataFrame(items, "item_id LONG, text STRING")).collect()
    want = {}
    for i, t in rows:
        for j, x in items:
            x = D.normal((x or "").encode())
            if len(x) >= D.Q:
                e = brute.nearest_part(x, D.normal((t or "").encode()))
                if e <= D.edit_budget(len(x)):
                    want[i, j] = e
    assert {(r.doc_id, r.item_id): r.edits for r in got} == want and len(want) > 30


def test_banded_alignment_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint32)
        item = rng.integers(0, 3, rng.integers(1, 12)).astype(np.uint32)
        best = brute.nearest_part(list(item), list(text))
        hit = D.banded(item, text, -len(item), len(text), len(item))
        assert hit[0] == best
        assert brute.nearest_part(list(item), list(text[hit[1] : hit[2]])) == best and hit[2] - hit[1] <= len(item) + best


def test_blocks_of_items_change_nothing(spark, documents, monkeypatch):
    items = [(k, prose(15)) for k in range(9)]
    docs = documents([(k, prose(10) + " " + items[k % 9][1] + " " + prose(5)) for k in range(30)])
    bench = spark.createDataFrame([*items, items[0]], "item_id LONG, text STRING")
    one = sorted(map(tuple, D.query(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 150)
    assert sorted(map(tuple, D.query(docs, bench).collect())) == one and len(one) >= 30
    assert D.clean(docs, bench).count() == 0


def test_clean_keeps_the_rest(spark, documents):
    docs = documents(ODD).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id LONG, text STRING")
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i, _ in ODD if i not in (8, 11))
    none = bench.limit(0)
    assert D.clean(docs, none).count() == len(ODD) and D.query(docs, none).count() == 0 and D.query(docs.limit(0), bench).count() == 0


def test_short_items_are_found_between_word_boundaries(spark, documents):
    items = [(1, "Short"), (2, "a b"), (3, "?!"), (4, " "), (5, "日本"), (6, "tiny item here")]
    rows = [(1, "in SHORT: a"), (2, "shorts, a bc"), (3, "xa b a\n b a b."), (4, "so?! a"), (5, "日本語"), (6, "日本 語"), (7, None), (8, "the tiny item here")]
    docs, benchmark = documents(rows), spark.createDataFrame(items, "item_id LONG, text STRING")
    got = sorted((r.doc_id, r.item_id, r.edits, r.n_places, r.first_char) for r in D.query(docs, benchmark).collect())
    assert got == [(1, 1, 0, 1, 3), (3, 2, 0, 2, 5), (4, 3, 0, 1, 2), (6, 5, 0, 1, 0), (8, 6, 0, 1, 4)]
    assert sorted(r.doc_id for r in D.clean(docs, benchmark).collect()) == [2, 5, 7]
