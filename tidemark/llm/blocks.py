"""Blocks of documents with a word list of their own, and the exchange of distinct words with word shards.

A block is a run of documents of about ``BLOCK_BYTES`` text: its distinct words, and per document the positions as
numbers into that list. Blocks are written once. Only the distinct words of a block travel: words fall into buckets by
the hash of their first half (six bytes at least), so that like words compress together. Blocks count their words per
bucket; small buckets share a shard, and a bucket above ``SHARD_WORDS`` (addresses, ids, padded numbers with one first half)
is split by the hash of the whole word. In its shard every distinct word of the corpus is met exactly once, and an answer
per word travels back. A word that makes up a third of all text is one entry per block, so no shard is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack, pack_words, unpack, unpack_words, utf8

BLOCK_BYTES = 16 << 20
#: zstd level of the positions, the largest part of what is written and shuffled.
TOKEN_LEVEL = 16
#: Words of blocks that meet in one shard task, about; at most twice as many.
SHARD_WORDS = 400_000
#: Buckets in which blocks count their words.
BUCKETS = 4096
BLOCK = "block LONG, doc_ids ARRAY<LONG>, lens BINARY, tokens BINARY, words BINARY, n_words LONG, mark LONG, buckets BINARY"
_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("tokens", pa.binary()),
                    ("words", pa.binary()), ("n_words", pa.int64()), ("mark", pa.int64()), ("buckets", pa.binary())])


def number_words(docs: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, frequent ones first and in byte order among equals, and every position as a number into them."""
    flat = [w for d in docs for w in d]
    words = sorted(set(flat))
    index = dict(zip(words, range(len(words))))
    ids = np.fromiter(map(index.__getitem__, flat), np.uint32, len(flat))
    count = np.bincount(ids, minlength=len(words))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    return [words[i] for i in order.tolist()], rank[ids]


def make_blocks(docs: DataFrame, split: Callable[[bytes], list[bytes]], block_bytes: int = BLOCK_BYTES, mark: bytes | None = None) -> DataFrame:
    """One row per block; ``mark`` is the number of that word in the block. The number of a block is unique in the written table; nothing relies on it being stable."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        ids, words, size, n = [], [], 0, 0

        def block():
            names, tokens = number_words(words)
            lens = np.fromiter(map(len, words), np.uint32, len(words))
            return pa.record_batch([[task + n], [ids], [pack(lens)], [pack(tokens, level=TOKEN_LEVEL)], [pack_words(names)], [len(names)],
                                    [names.index(mark) if mark is not None else None],
                                    [pack(np.bincount(buckets_of(names), minlength=BUCKETS).astype(np.uint32))]], schema=_BLOCK)

        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), utf8(b["text"])):
                ids.append(doc)
                words.append(split(text))
                size += len(text) + 64
                if size >= block_bytes:
                    yield block()
                    ids, words, size, n = [], [], 0, n + 1
        if ids:
            yield block()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCK)


def buckets_of(words: list[bytes]) -> np.ndarray:
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w[: max(6, len(w) // 2)]) for w in words), np.uint64, len(words))
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


class Shards(NamedTuple):
    """``count`` shards: bucket b has the ``parts[b]`` shards from ``first[b]`` on."""

    count: int
    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray) -> "Shards":
        """From the words per bucket: neighbouring small buckets share a shard, large ones have several of their own."""
        first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // SHARD_WORDS))
        count, held = 0, 0  # shards that are closed, words in the open one
        for b in np.flatnonzero(parts == 1).tolist():
            first[b] = count
            held += int(sizes[b])
            if held >= SHARD_WORDS:
                count, held = count + 1, 0
        count += held > 0
        for b in np.flatnonzero(parts > 1).tolist():
            first[b] = count
            count += int(parts[b])
        return cls(max(1, count), first, parts)

    def shard(self, words: list[bytes]) -> np.ndarray:
        bucket = buckets_of(words)
        out, parts = self.first[bucket], self.parts[bucket]
        for i in np.flatnonzero(parts > 1).tolist():
            out[i] += xxhash.xxh3_64_intdigest(words[i], 1) % int(parts[i])
        return out


def shards_for(blocks: DataFrame) -> Shards:
    def run(batches):
        total = sum((unpack(x).astype(np.int64) for b in batches for x in b["buckets"].to_pylist()), np.zeros(BUCKETS, np.int64))
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], ["k", "n"])

    sizes = np.zeros(BUCKETS, np.int64)
    for r in blocks.select("buckets").mapInArrow(run, "k LONG, n LONG").groupBy("k").agg(F.sum("n").alias("n")).collect():
        sizes[r.k] = r.n
    return Shards.of(sizes)


SENT = "shard INT, block LONG, at BINARY, words BINARY, extra BINARY"
ANSWER = "block LONG, kind INT, at BINARY, answer BINARY"
#: Kind of an answer that is no answer to a block but a part of the shard's own table.
TABLE = -1


def send_words(blocks: DataFrame, shards: Shards, extra: Callable[[dict], np.ndarray] | None = None) -> DataFrame:
    """One row per block and shard: the words of that shard, with their numbers in the block and ``extra`` of each."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                words = unpack_words(row["words"])
                shard = shards.shard(words)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards.count + 1))
                more = extra(row) if extra else None
                out = {k: [] for k in ("shard", "block", "at", "words", "extra")}
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    at = order[cuts[s] : cuts[s + 1]]
                    out["shard"].append(s)
                    out["block"].append(row["block"])
                    out["at"].append(pack(np.diff(at, prepend=0).astype(np.uint32)))
                    out["words"].append(pack_words([words[i] for i in at.tolist()]))
                    out["extra"].append(pack(more[at]) if extra else None)
                yield pa.record_batch([pa.array(out["shard"], pa.int32()), pa.array(out["block"], pa.int64()), pa.array(out["at"], pa.binary()),
                                       pa.array(out["words"], pa.binary()), pa.array(out["extra"], pa.binary())], list(out))

    return blocks.mapInArrow(run, SENT)


def answers(rows: list[tuple]) -> pa.Table:
    block, kind, at, answer = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"block": pa.array(block, pa.int64()), "kind": pa.array(kind, pa.int32()), "at": pa.array(at, pa.binary()), "answer": pa.array(answer, pa.binary())})


def word_index(lists: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of a shard in byte order, and each list as numbers into them."""
    words = sorted(set().union(*lists))
    index = dict(zip(words, range(len(words))))
    return words, [np.fromiter(map(index.__getitem__, x), np.int64, len(x)) for x in lists]


def positions(at: bytes) -> np.ndarray:
    return np.cumsum(unpack(at).astype(np.int64))
