"""SimHash near-duplicates: 64-bit fingerprints, linked through BK-trees, joined to components.

Fingerprints within ``radius`` bits agree on at least one of radius + 1 bands of bits, so each band value is a shard with
a tree of its own: children are keyed by their integer Hamming distance to the parent, and a search follows only edges
within the radius. A shard's tree goes to the one task that searches it; sending all trees to every task would broadcast
something as large as the corpus. Shards above ``SHARD_LIMIT`` distinct fingerprints are cut again by the same argument
on the bits left, so no link is lost. A task returns a star per linked group, never all pairs.

Defined results: null and empty texts have the fingerprint zero and are linked to each other; repeated rows keep one
row each; rows with a null id get a component like any other (null ids are not a component's smallest id); texts
of any length are read whole; a bit set in exactly half the hashes is 0; an empty table gives no row; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage, utf8
from .components import components, local_components

SEED = 42
SHARD_LIMIT = 50_000
#: Rows that one task of the tree search gets, about.
TASK_ROWS = 400_000


def shingles(text: bytes, width: int) -> list[bytes]:
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-width]].tolist()
    return [line[i:j] for i, j in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprint(text: bytes, width: int = 3) -> int:
    parts = shingles(text, width)
    if not parts:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    def run(batches):
        for b in small(batches):
            fp = np.array([fingerprint(t, width) for t in utf8(b["text"])], np.uint64).view(np.int64)
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id LONG, fp LONG")


def distance(a, b):
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKForest:
    """One BK-tree per shard over arrays, all built level by level: the first value of a group becomes its node, the
    others go to the child keyed by their distance to it."""

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        self.values = values
        n = len(values)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        order = np.argsort(shard, kind="stable")
        group = np.cumsum(np.r_[False, shard[order][1:] != shard[order][:-1]])
        first = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
        self.root = np.empty(n, np.int64)
        self.root[order] = order[first][group] if n else order
        items, node = order[~first], order[first][group][~first] if n else order
        while len(items):
            d = distance(values[items], values[node])
            sort = np.lexsort((d, node))
            items, node, d = items[sort], node[sort], d[sort]
            new = np.r_[True, (node[1:] != node[:-1]) | (d[1:] != d[:-1])]
            child = items[new][np.cumsum(new) - 1]
            self.parent[items[new]], self.edge[items[new]] = node[new], d[new]
            items, node = items[~new], child[~new]
        kids = np.flatnonzero(self.parent >= 0)
        key = self.parent[kids] * 128 + self.edge[kids]
        sort = np.argsort(key, kind="stable")
        self.key, self.kids = key[sort], kids[sort]

    def links(self, radius: int, chunk: int = 20_000):
        """(query, node) pairs within the radius, node before query in the tree's order, in pieces."""
        for at in range(0, len(self.values), chunk):
            q = np.arange(at, min(at + chunk, len(self.values)))
            node = self.root[q]
            while len(q):
                d = distance(self.values[q], self.values[node])
                hit = (d <= radius) & (node != q)
                yield q[hit], node[hit]
                low = np.searchsorted(self.key, node * 128 + np.maximum(d - radius, 0), "left")
                high = np.searchsorted(self.key, node * 128 + d + radius, "right")
                n = high - low
                q = np.repeat(q, n)
                pos = np.arange(len(q)) + np.repeat(low - (np.cumsum(n) - n), n)
                node = self.kids[pos]


def _bits(first: int, n: int) -> int:
    """A mask of n bits from ``first``, as a signed 64-bit number."""
    m = ((1 << n) - 1) << first
    return m - (1 << 64) if m >= 1 << 63 else m


def bands(masks: list[int], ways: int) -> list[list[tuple[int, int]]]:
    """Cuts the bit positions of ``masks`` into ``ways`` parts of contiguous runs (first bit, number of bits)."""
    each = -(-len(masks) // ways)
    return [masks[i : i + each] for i in range(0, len(masks), each)]


def sharded(fps: DataFrame, radius: int) -> DataFrame:
    """(shard, fp): every two values within the radius share a shard; shards over the limit are cut on further bits.

    A level's rows carry, per shard, the bits not used so far; each cut takes radius + 1 parts of them.
    """
    ways = radius + 1
    done, todo = [], [(fps.select("fp", F.lit(0).cast("long").alias("shard")), list(range(64)))]
    for level in range(3):
        nxt = []
        for df, free in todo:
            for part in bands(free, ways):
                mask = sum(1 << i for i in part)
                mask = mask - (1 << 64) if mask >> 63 else mask
                keyed = df.select("fp", F.xxhash64("shard", F.lit(mask), F.col("fp").bitwiseAND(F.lit(mask))).alias("shard"))
                rest = [i for i in free if i not in part]
                nxt.append((keyed, rest))
        every = nxt[0][0]
        for df, _ in nxt[1:]:
            every = every.unionByName(df)
        sizes = stage(every.groupBy("shard").count().where("count > 1"), "bk-shards")
        hot = sizes.where(F.col("count") > SHARD_LIMIT).select("shard")
        done.append(every.join(sizes.where(F.col("count") <= SHARD_LIMIT).select("shard"), "shard", "left_semi"))
        if level == 2 or hot.isEmpty():
            if level == 2:
                done.append(every.join(hot, "shard", "left_semi"))
            break
        todo = [(df.join(hot, "shard", "left_semi"), rest) for df, rest in nxt]
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select("shard", "fp")


def linked(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): each distinct value with the smallest value of its linked group in a shard; transitively all links."""
    rows = stage(sharded(fps, radius), "bk-rows")
    tasks = max(1, -(-rows.count() // TASK_ROWS))

    def search(t: pa.Table) -> pa.Table:
        shard, values = np.asarray(t["shard"]), np.asarray(t["fp"]).view(np.uint64)
        forest = BKForest(shard, values)
        pairs = list(forest.links(radius))
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        label = local_components(len(values), a, b)
        other = np.flatnonzero(label != np.arange(len(values)))
        signed = values.view(np.int64)
        return pa.table({"a": pa.array(signed[other], pa.int64()), "b": pa.array(signed[label[other]], pa.int64())})

    keyed = rows.withColumn("task", F.pmod(F.xxhash64(F.lit(7), "shard"), F.lit(tasks)))
    return keyed.groupBy("task").applyInArrow(search, "a LONG, b LONG").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row."""
    prints = stage(fingerprints(docs, width), "simhash")
    fps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-values")
    roots = components(linked(fps, radius))
    named = roots.join(fps, roots["node"] == fps["fp"]).select("node", "root", "first_doc")
    least = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_value = (fps.join(named.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "fp", "left")
                .select("fp", F.coalesce("component_id", "first_doc").alias("component_id")))
    return prints.join(by_value, "fp")


def query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
