"""Word shards: every distinct word has one shard, and like words do not make one hot."""

from collections import Counter, defaultdict

import pytest

from tidemark.llm import blocks as B
from tidemark.llm.common import unpack_words

ALIKE = [f"https://www.example.org/item/{k:07d}" for k in range(4000)] + [f"{k:011d}" for k in range(4000)]


@pytest.mark.parametrize("words", [ALIKE, [f"{k * 7919 % 8000}w" for k in range(8000)]], ids=["alike", "mixed"])
def test_no_word_shard_is_hot(documents, monkeypatch, words):
    monkeypatch.setattr(B, "SHARD_WORDS", 500)
    docs = documents([(k, " ".join(words[k::40]) + " common") for k in range(40)])
    made = B.make_blocks(docs, lambda t: t.split(), 8_000).cache()
    assert made.count() > 3
    shards, size = defaultdict(set), Counter()
    for r in B.send_words(made, B.shards_for(made)).collect():
        for w in unpack_words(r.words):
            shards[w].add(r.shard)
            size[r.shard] += 1
    assert set(shards) == {w.encode() for w in words} | {b"common"}
    assert all(len(s) == 1 for s in shards.values())
    assert len(size) >= 8 and max(size.values()) <= 1000
