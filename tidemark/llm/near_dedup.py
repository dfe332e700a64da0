"""Near-dedup of documents: five-word shingles, Jaccard similarity of 0.8 or more, one document of each group stays.

Fingerprints of such pairs differ in about ten of 64 bits, too many for bands of bits. The shards of the BK-trees are
therefore the documents that share a minimum of their shingles under one of ``KEYS`` independent hash orders (a pair at 0.8
misses all of them with probability 0.2 ** 8; the radius misses about 2e-5 more, see the README). Inside a shard the tree's edges within ``RADIUS`` bits (more than four standard
deviations above ten) give the pairs to compare. A first search keeps the documents that have such a pair; their sets of
shingles are then fetched, pairs are compared exactly unless already connected, and a task returns stars of linked
documents. Shards of more than ``SHARD`` texts are cut into chunks, and every
two chunks meet in a task of their own, so that no task holds a hot shard and none of its pairs is left out.

Texts that are equal but for case and white space are one text from the start. Defined results: null and empty texts are
equal; fewer than five words are one shingle; of a group the smallest id stays (a null id only if there is no other), and
of rows equal in id and text one; texts of any length are read whole; of groups with equal smallest ids the smaller digest stays;
an empty table stays empty; all columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage, unused, utf8
from .components import components, local_components
from .simhash import BKForest, shingles

WIDTH, SIMILARITY, KEYS, RADIUS = 5, 0.8, 8, 22
SHARD = 2000
#: Texts from which on the intersections of a shard are counted all at once.
MANY = 24
#: Rows that search their trees at once: in a family of copies each meets most of its shard.
QUERIES = 1000
#: Rows of shards that share one task, about.
TASK_ROWS, SET_ROWS = 50_000, 4_000
_SEED = np.array([xxhash.xxh3_64_intdigest(b"order", k) for k in range(KEYS)], np.uint64)


def digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    parts = shingles(text, width)
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts)))


def mixed(part: np.ndarray) -> np.ndarray:
    """Every hash under each order: the seed of the order, then a full 64-bit finaliser (MurmurHash3)."""
    x = part[:, None] ^ _SEED
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prints_of(s: np.ndarray) -> tuple[int, list[int]]:
    """Fingerprint of a set, and its minimum under each hash order."""
    if not len(s):
        return 0, [0] * KEYS
    ones = np.zeros(64, np.int64)
    low = np.full(KEYS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 16384):
        part = s[at : at + 16384]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        low = np.minimum(low, mixed(part).min(0))
    fp = np.packbits(2 * ones > len(s), bitorder="little").view("<u8")[0]
    return int(np.uint64(fp).view(np.int64)), low.view(np.int64).tolist()


def prints(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in small(batches):
            rows = []
            for doc, text in zip(b["doc_id"].to_pylist(), utf8(b["text"])):
                s = shingle_set(text)
                rows.append((doc, digest(text), *prints_of(s), len(s)))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "digest", "fp", "keys", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id LONG, digest BINARY, fp LONG, keys ARRAY<LONG>, n LONG")


def with_digest(docs: DataFrame, name: str = "_digest") -> DataFrame:
    names = docs.columns

    def run(batches):
        for b in small(batches):
            own = pa.array([digest(t) for t in utf8(b["text"])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b[i] for i in range(len(names))), own], [*names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(b"").alias(name)).schema)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, set) of the texts in ``wanted``, each once."""

    def run(batches):
        for b in small(batches):
            yield pa.record_batch([b["digest"], pa.array([shingle_set(t).tobytes() for t in utf8(b["text"])], pa.binary())], ["digest", "set"])

    texts = with_digest(docs.select("text"), "digest").join(wanted, "digest", "left_semi").dropDuplicates(["digest"])
    return texts.mapInArrow(run, "digest BINARY, set BINARY")


def shared_counts(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all pairs of a shard, from products of 0/1 matrices over shingles that two sets hold."""
    n = len(sets)
    value, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    place = np.cumsum(count > 1) - 1  # columns of the shingles that occur twice
    keep = count[index] > 1
    row, col = row[keep], place[index[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((n, n), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        a, b = np.searchsorted(col, [at, at + columns])
        part = np.zeros((n, columns), np.float32)
        part[row[a:b], col[a:b] - at] = 1
        out += part @ part.T
    return out


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def promising(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """The rows (task, shard, digest, fp, n) that have another of their shard within the radius and of a possible size."""

    def run(t: pa.Table) -> pa.Table:
        size, hit = np.asarray(t["n"]).astype(float), np.zeros(len(t), bool)
        for q, node in BKForest(np.asarray(t["shard"]), np.asarray(t["fp"]).view(np.uint64)).links(radius, QUERIES):
            close = np.minimum(size[q], size[node]) >= similarity * np.maximum(size[q], size[node])
            hit[q[close]] = hit[node[close]] = True
        return t.filter(pa.array(hit))

    return rows.groupBy("task").applyInArrow(run, rows.schema)


def compared(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(a, b): digests linked inside a shard or between two chunks of one, as stars."""

    def run(t: pa.Table) -> pa.Table:
        names, shard = t["digest"].to_pylist(), np.asarray(t["shard"])
        values = np.asarray(t["fp"]).view(np.uint64)
        sets = [np.frombuffer(s, np.uint64) for s in t["set"].to_pylist()]
        size = np.array([len(s) for s in sets], float)
        label = np.arange(len(names))
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1], True])
        large = np.zeros(len(names), bool)
        for own in (order[a:z] for a, z in zip(cuts, cuts[1:]) if z - a >= MANY):  # large shards: intersections by products
            large[own] = True
            counts = shared_counts([sets[i] for i in own.tolist()])
            for q, node in BKForest(shard[own], values[own]).links(radius, QUERIES):
                both = counts[q, node]
                hit = both >= similarity * (size[own[q]] + size[own[node]] - both) - 1e-9
                label = merge(label, own[q[hit]], own[node[hit]])
        few = np.flatnonzero(~large)
        for q, node in BKForest(shard[few], values[few]).links(radius, QUERIES):
            q, node = few[q], few[node]
            close = np.minimum(size[q], size[node]) >= similarity * np.maximum(size[q], size[node])
            a, b = [], []
            for x, y in zip(q[close].tolist(), node[close].tolist()):
                if label[x] != label[y] and similar(sets[x], sets[y], similarity):
                    a.append(x)
                    b.append(y)
                    if len(a) >= 64:  # connect now and then, so that later pairs of a large group need no comparison
                        label = merge(label, a, b)
                        a, b = [], []
            if a:
                label = merge(label, a, b)
        other = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": pa.array([names[i] for i in other.tolist()], pa.binary()), "b": pa.array([names[label[i]] for i in other.tolist()], pa.binary())})

    return rows.groupBy("task").applyInArrow(run, "a BINARY, b BINARY").where("a <> b").distinct()


def merge(label: np.ndarray, a, b) -> np.ndarray:
    n = len(label)
    if not len(a):
        return label
    return local_components(n, np.concatenate([np.arange(n), a]).astype(np.int64), np.concatenate([label, b]).astype(np.int64))


def groups(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Texts (digest, doc_id, rows), and (node, root) of the digests that are linked to others."""
    texts = stage(prints(docs).groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("n").alias("n")), "near-texts")
    keyed = texts.where("n > 0").select("digest", "fp", "n", F.posexplode("keys").alias("order", "low"))
    keyed = keyed.select("digest", "fp", "n", F.xxhash64("order", "low").alias("shard"))
    sizes = keyed.groupBy("shard").count().where("count > 1")
    rows = stage(keyed.join(sizes, "shard"), "near-shards")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("count") / SHARD)).cast("int")
    own = rows.select("digest", "fp", "n", "shard", chunks.alias("chunks"), F.pmod(F.xxhash64("digest"), chunks).cast("int").alias("chunk"))
    meet = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "digest", "fp", "n", F.xxhash64("shard", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("shard"), "chunks")

    def dealt(df: DataFrame, total: int, each: int) -> DataFrame:
        """Cut shards have a task each, the others are packed into tasks of about ``each`` rows."""
        return df.withColumn("task", F.when(F.col("chunks") > 1, F.col("shard")).otherwise(F.pmod(F.xxhash64("shard"), F.lit(max(1, -(-total // each))))))

    near = stage(promising(dealt(meet, rows.count(), TASK_ROWS), similarity, radius), "near-candidates")
    wanted = near.select("digest").distinct()
    if wanted.isEmpty():
        return texts, docs.sparkSession.createDataFrame([], "node BINARY, root BINARY")
    sets = stage(sets_of(docs, wanted), "near-sets")
    return texts, components(compared(dealt(near, near.count(), SET_ROWS).join(sets, "digest"), similarity, radius))


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    texts, linked = groups(docs, similarity, radius)
    named = linked.withColumnRenamed("node", "digest").join(texts.select("digest", "doc_id"), "digest")
    # nulls last: a null id stays only if there is no other
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("best"))
    fate = named.join(best, "root").select("digest", (F.col("digest") == F.col("best.digest")).alias("stays"))
    dig, keep, stays = unused(docs, "_digest", "_keep", "_stays")
    touched = (texts.join(fate, "digest", "left").where("rows > 1 OR stays IS NOT NULL")
               .select(F.col("digest").alias(dig), F.col("doc_id").alias(keep), F.coalesce("stays", F.lit(True)).alias(stays)))
    joined = with_digest(docs, dig).join(touched, dig, "left")
    free = joined.where(F.col(stays).isNull())
    one = joined.where(F.col(stays) & F.col("doc_id").eqNullSafe(F.col(keep))).dropDuplicates([dig])
    return free.unionByName(one).select(docs.columns)
