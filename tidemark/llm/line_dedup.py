"""Reversible line dedup: exact reference tables of line keys, with a cuckoo filter of the repeated keys per shard.

State
    ``postings``  one row per (key, document): the exact references. Insertion appends, deletion removes.
    ``counts``    one row per key: references and the smallest document that holds it.
    ``filters``   one row per shard: a cuckoo filter of the keys with two references or more.

A line first asks its shard's filter; only keys that may be repeated reach the exact table. The filter supports
deletion, so that ``delete`` takes keys out which fall below two references, and the state is again the one that
inserting the remaining documents would give.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` are never dropped; two rows
with the same id are one document (none of its own lines goes because of the other row); rows with a null id keep all
lines and hold no key; texts and lines of any length are read whole; of equal lines in one document all stay or all go; an
empty table gives no row; all columns stay, but n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_for, small, stage, unused, utf8

MIN_CHARS = 10
#: Keys per shard: bounds one filter (about 2.2 MB) and the rows of one group.
SHARD_KEYS = 500_000
#: The slice counts of the shards, 12 bytes each, are broadcast up to this many shards and joined by shuffle beyond.
BROADCAST_SHARDS = 200_000


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    n = len(key)
    return n >= min_chars and (n >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id), each key once per row of ``docs``; the key is a 128-bit digest of the normalised line."""

    def run(batches):
        for b in small(batches):
            keys, ids = [], []
            for doc, text in zip(b["doc_id"].to_pylist(), utf8(b["text"])):
                own = {k for k in map(line_key, text.split(b"\n")) if len(k) >= min_chars}
                own = [_digest(k) for k in own if _long_enough(k, min_chars)]
                keys += own
                ids += [doc] * len(own)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "key BINARY, doc_id LONG")


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; a key lives in one of two buckets, so that it can be taken out again.

    ``keys`` are pairs of 64-bit halves of the digest. Bulk insertion fills both buckets in rounds and evicts by the
    cuckoo rule; what a round limit leaves over makes the table double (all keys are at hand when it is built).
    """

    SLOTS = 4

    def __init__(self, buckets: int):
        self.mask = np.uint64(buckets - 1)
        self.slots = np.zeros((buckets, self.SLOTS), np.uint32)

    @staticmethod
    def _parts(digests: np.ndarray):
        return digests[:, 0], (digests[:, 1] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def _first(self, h):
        return (h & self.mask).astype(np.int64)

    def _other(self, bucket, fp):
        spread = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((bucket.astype(np.uint64) ^ (spread >> np.uint64(17))) & self.mask).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> "CuckooFilter":
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(digests)) / (cls.SLOTS * 0.85)))))
        while True:
            made = cls(buckets)
            if made.insert(digests):
                return made
            buckets *= 2

    def insert(self, digests: np.ndarray, rounds: int = 500) -> bool:
        h, fp = self._parts(digests)
        at = self._first(h)
        rng = np.random.default_rng(len(digests))
        for step in range(rounds):
            for _ in range(2):
                if not len(at):
                    return True
                order = np.argsort(at, kind="stable")
                at, fp = at[order], fp[order]
                first = np.r_[True, at[1:] != at[:-1]]
                rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                free = self.slots[at] == 0
                fits = rank < free.sum(1)
                slot = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
                self.slots[at[fits], slot] = fp[fits]
                at, fp = self._other(at[~fits], fp[~fits]), fp[~fits]
            if not len(at):
                return True
            _, one = np.unique(at, return_index=True)  # one eviction per bucket and round
            slot = rng.integers(0, self.SLOTS, len(one))
            old = self.slots[at[one], slot].copy()
            self.slots[at[one], slot] = fp[one]
            fp[one] = old
            at[one] = self._other(at[one], old)
        return False

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        h, fp = self._parts(digests)
        at = self._first(h)
        return (self.slots[at] == fp[:, None]).any(1) | (self.slots[self._other(at, fp)] == fp[:, None]).any(1)

    def remove(self, digests: np.ndarray) -> None:
        """Only keys that were inserted may be removed."""
        h, fp = self._parts(digests)
        for a, f in zip(self._first(h), fp):
            for at in (a, self._other(np.array([a]), np.array([f]))[0]):
                hit = np.flatnonzero(self.slots[at] == f)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> "CuckooFilter":
        slots = np.frombuffer(b, np.uint32).reshape(-1, cls.SLOTS).copy()
        made = cls(len(slots))
        made.slots = slots
        return made


def digest_array(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def shard_of(key, shards: int):
    """The shard of a digest, from its leading bytes."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


class LineDedup:
    """Postings, counts and filters of a set of documents; every change returns a new, written state."""

    def __init__(self, posts: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_chars: int):
        self.posts, self.counts, self.filters, self.shards, self.min_chars = posts, counts, filters, shards, min_chars

    @classmethod
    def _of(cls, posts, counts, min_chars, shards=None):
        """Counts are exact; the filters are made per shard from the repeated keys alone."""
        repeated = counts.where("refs >= 2")
        shards = shards or groups_for(repeated.count(), SHARD_KEYS)

        def one(t: pa.Table) -> pa.Table:
            made = CuckooFilter.build(digest_array(t["key"].to_pylist()))
            return pa.table({"shard": t["shard"][:1], "filter": pa.array([made.to_bytes()], pa.binary())})

        filters = stage(repeated.select("key", shard_of("key", shards).alias("shard")).groupBy("shard")
                        .applyInArrow(one, "shard INT, filter BINARY"), "cuckoo")
        return cls(posts, counts, filters, shards, min_chars)

    @staticmethod
    def _count(posts: DataFrame) -> DataFrame:
        return posts.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"))

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, unique_ids: bool = False) -> "LineDedup":
        """``unique_ids``: ids are known not to repeat, so that postings need no distinct."""
        posts = postings(docs, min_chars)
        posts = stage(posts if unique_ids else posts.distinct(), "line-postings")
        return cls._of(posts, stage(cls._count(posts), "line-counts"), min_chars)

    def insert(self, docs: DataFrame) -> "LineDedup":
        """Documents that are already held add only keys they did not hold."""
        new = postings(docs, self.min_chars).distinct().join(self.posts, ["key", "doc_id"], "left_anti")
        new = stage(new, "line-postings")
        counts = self.counts.unionByName(self._count(new)).groupBy("key").agg(F.sum("refs").alias("refs"), F.min("first_doc").alias("first_doc"))
        counts = stage(counts, "line-counts")
        crossed = counts.where("refs >= 2").join(self.counts.where("refs >= 2"), "key", "left_anti")
        return self._changed(self.posts.unionByName(new), counts, crossed, add=True)

    def delete(self, ids: DataFrame) -> "LineDedup":
        """Takes the documents of ``ids.doc_id`` out; only keys that they held are counted anew."""
        gone = ids.select("doc_id").distinct()
        touched = stage(self.posts.join(gone, "doc_id", "left_semi").select("key").distinct(), "line-touched")
        posts = stage(self.posts.join(gone, "doc_id", "left_anti"), "line-postings")
        again = self._count(posts.join(touched, "key", "left_semi"))
        counts = stage(self.counts.join(touched, "key", "left_anti").unionByName(again), "line-counts")
        crossed = self.counts.where("refs >= 2").join(touched, "key", "left_semi").join(counts.where("refs >= 2"), "key", "left_anti")
        return self._changed(posts, counts, crossed, add=False)

    def _changed(self, posts, counts, crossed, add: bool) -> "LineDedup":
        shards = self.shards

        def one(key, old: pa.Table, delta: pa.Table) -> pa.Table:
            digests = digest_array(delta["key"].to_pylist()) if len(delta) else np.zeros((0, 2), np.uint64)
            made = CuckooFilter.from_bytes(old["filter"][0].as_py()) if len(old) else CuckooFilter.build(digests[:0])
            if not add:
                made.remove(digests)
            elif not made.insert(digests):
                return pa.table({"shard": [key[0].as_py()], "filter": pa.array([None], pa.binary())}, schema=pa.schema({"shard": pa.int32(), "filter": pa.binary()}))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})

        delta = crossed.select("key", shard_of("key", shards).alias("shard")).groupBy("shard")
        filters = stage(self.filters.groupBy("shard").cogroup(delta).applyInArrow(one, "shard INT, filter BINARY"), "cuckoo")
        if not filters.where("filter IS NULL").isEmpty():  # a shard is full: all its keys are in the counts, so make it anew
            return self._of(posts, counts, self.min_chars)
        return LineDedup(posts, counts, filters, shards, self.min_chars)

    def dropped(self, among: DataFrame | None = None) -> DataFrame:
        """(doc_id, keys): the digests of the lines that each document loses; documents that lose none are absent.

        A posting is asked of its shard's filter in the task that holds the shard's repeated keys; the shard is cut
        into slices by document, so that a line which a third of all documents share is spread over many tasks.
        """
        posts = (self.posts if among is None else among).select("doc_id", "key", shard_of("key", self.shards).alias("shard"))
        sizes = stage(posts.groupBy("shard").count().select("shard", F.ceil(F.col("count") / (4 * SHARD_KEYS)).cast("int").alias("slices")), "line-slices")
        left = posts.join(F.broadcast(sizes) if self.shards <= BROADCAST_SHARDS else sizes, "shard")
        left = left.select("key", "doc_id", "shard", F.pmod(F.xxhash64("doc_id"), "slices").cast("int").alias("slice"))

        def candidates(key, asked: pa.Table, kept: pa.Table) -> pa.Table:
            if not len(kept) or not len(asked):
                return asked.select(["key", "doc_id"]).slice(0, 0)
            probe = CuckooFilter.from_bytes(kept["filter"][0].as_py())
            hit = probe.may_hold(digest_array(asked["key"].to_pylist()))
            return asked.select(["key", "doc_id"]).filter(pa.array(hit))

        right = self.filters.join(sizes, "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        maybe = left.groupBy("shard", "slice").cogroup(right.groupBy("shard", "slice")).applyInArrow(candidates, "key BINARY, doc_id LONG")
        exact = maybe.join(self.counts.where("refs >= 2").select("key", "first_doc"), "key").where("doc_id <> first_doc")
        return exact.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))


def dedup_lines(docs: DataFrame, state: LineDedup | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` replaced by its remaining lines, plus ``n_lines`` and ``n_dropped``.

    Clashing columns of these two names are replaced; all other columns stay.
    """
    state = state or LineDedup.build(docs, min_chars)
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    doc, gone = unused(docs, "_doc", "_lost")
    lost = state.dropped().withColumnsRenamed({"doc_id": doc, "keys": gone})
    joined = docs.join(lost, F.col("doc_id") == F.col(doc), "left").drop(doc)
    at = names.index("text")

    def run(batches):
        for b in small(batches):
            texts, n, k = [], [], []
            for text, lost in zip(utf8(b["text"]), b[gone].to_pylist()):
                lines = text.split(b"\n")
                kept = lines
                if lost:
                    lost = set(lost)
                    kept = [x for x in lines if not (len(key := line_key(x)) >= min_chars and _digest(key) in lost)]
                n.append(len(lines))
                k.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept))
            cols = [b[c] for c in names]
            cols[at] = pc.cast(pa.array(texts, pa.binary()), pa.string())
            yield pa.record_batch([*cols, pa.array(n, pa.int64()), pa.array(k, pa.int64())], [*names, "n_lines", "n_dropped"])

    schema = docs.select(*names, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    return joined.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
