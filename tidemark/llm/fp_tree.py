"""Ranked lexical search over document FP-trees: the best documents of every item by an integer BM25-like score.

The items' terms are the vocabulary. One pass over the texts leaves, per document, its length and its *restricted* term
vector: the vocabulary terms it holds, with their counts. A task reads these vectors in blocks and puts each block into an
FP-tree: terms ordered by document frequency, so that documents share the path of their frequent terms. Every node keeps
the tf maximum of each term and the minimum of m over its subtree, from which a score that no document below can exceed
follows for every item. Per item, depth-first branch-and-bound takes the child with the highest bound first and skips each
subtree whose bound is below the item's 50th score so far; what is left is scored exactly. The scores found in one tree are
the bar for the next tree of the task; tasks send at most 50 rows per item, which are ranked in two levels.

Items are taken in slices of at most ``SLICE`` bytes of text (a longer item is a slice of its own): a slice's vocabulary and
weights are all that is sent to the tasks, one slice after the other.

Defined results: null texts have no terms; null ids rank after all others of the same score; rows with repeated ids are
documents (items) of their own; very long texts are split piece by piece; equal scores rank by id; items without a term, or
whose terms no document holds, have no row, and so has an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stage, utf8

TOP = 50
#: Bytes of item text whose vocabulary is sent to the tasks at once.
SLICE = 1 << 23
#: Documents and term counts after which a tree is closed, and documents that are scored together.
TREE, POSTINGS, LEAF = 8192, 2_000_000, 128
#: Bytes of a text that are split at once.
PIECE = 1 << 22
#: ASCII digits and letters (lower-cased) and all bytes of other characters belong to terms; the rest separates them.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LAST = np.iinfo(np.int64).max


def terms_of(text: bytes):
    """Lists of a text's terms, piece by piece."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        to = text.find(b" ", at + PIECE)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def vector(text: bytes, vocabulary: dict) -> tuple[int, list, list]:
    """Number of terms, and number and count of each term of the vocabulary."""
    n, held = 0, Counter()
    for words in terms_of(text):
        n += len(words)
        held.update(words)
    pairs = sorted((vocabulary[w], k) for w, k in held.items() if w in vocabulary)
    return n, [t for t, _ in pairs], [k for _, k in pairs]


def vectors(docs: DataFrame, vocabulary: dict) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term at all."""

    def run(batches):
        for b in small(batches, 500):
            rows = [vector(t, vocabulary) for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id LONG, n LONG, terms ARRAY<INT>, tfs ARRAY<LONG>").where("n > 0")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Items:
    """The items of a slice over the slice's terms, which are numbered from the most to the least frequent one."""

    def __init__(self, items: list[np.ndarray], df: np.ndarray, documents: int, tokens: int):
        order = np.argsort(-df, kind="stable")
        self.rank = np.empty(len(df), np.int32)
        self.rank[order] = np.arange(len(df), dtype=np.int32)
        self.weights = np.array([weight(documents, int(x)) for x in df[order]], np.int64)
        self.terms = [np.sort(self.rank[t]) for t in items]
        self.flat = np.concatenate(self.terms)
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in self.terms])))[:-1]
        self.documents, self.tokens = documents, tokens

    def gains(self, terms: np.ndarray, tfs: np.ndarray, m) -> np.ndarray:
        """What each count adds to a score; it rises with tf and falls with m."""
        return self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))


class Tree:
    """An FP-tree over a block: documents in the order of their paths, nodes as ranges of them.

    A path that no document leaves is one node, and neighbouring subtrees with ``LEAF`` documents or fewer together are scored
    together; every node has the bound of each item.
    """

    def __init__(self, items: Items, n: np.ndarray, lens: np.ndarray, terms: np.ndarray, tfs: np.ndarray, leaf: int = LEAF):
        m = 50 + (50 * n * items.documents) // items.tokens
        ranks = items.rank[terms].astype(np.int64)
        owner = np.repeat(np.arange(len(n)), lens)
        by = np.lexsort((ranks, owner))
        ranks, tfs = ranks[by], tfs[by]
        ends = np.cumsum(lens)
        coded = ranks.astype(">u4").tobytes()
        paths = [coded[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lens.tolist())]
        self.order = np.array(sorted(range(len(n)), key=paths.__getitem__), np.int64)
        self.paths = [paths[i] for i in self.order]
        lens = lens[self.order]
        self.starts = np.concatenate(([0], np.cumsum(lens)))
        pick = np.repeat(ends[self.order] - np.cumsum(lens), lens) + np.arange(int(lens.sum()))
        self.items, self.m = items, m[self.order]
        self.terms, self.tfs = ranks[pick], tfs[pick]
        self.gains = items.gains(self.terms, self.tfs, np.repeat(self.m, lens))
        self.lens, self.leaf = lens, leaf
        self.nodes: list[tuple] = []  # (first document, last + 1, children or None), children before parents
        self.kept: list[tuple] = []  # (terms, tf maxima, m minimum) per node
        self.bounds: list[np.ndarray] = []
        self.scratch = np.zeros(len(items.weights), np.int64)
        self.root = self.grow()

    def grow(self) -> int:
        """Nodes from the leaves up, without recursion: a path may be longer than any stack."""
        done: list[int] = []
        todo: list[tuple] = [("open", 0, len(self.lens))]
        while todo:
            what, a, b = todo.pop()
            if what == "close":  # b nodes on top of done are the children
                kids, done[-b:] = done[-b:], []
                done.append(self.add(self.nodes[kids[0]][0], self.nodes[kids[-1]][1], kids))
            elif b - a <= self.leaf:
                done.append(self.add(a, b, None))
            else:
                parts = self.split(a, b)
                todo.append(("close", 0, len(parts)))
                todo += [("open", x, y) for x, y in reversed(parts)]
        return done[0]

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Subtrees below the path that documents a .. b - 1 share; small neighbours go together."""
        first, last = self.paths[a], self.paths[b - 1]
        depth = next((k for k in range(min(len(first), len(last)) // 4) if first[4 * k : 4 * k + 4] != last[4 * k : 4 * k + 4]), min(len(first), len(last)) // 4)
        if first == last:  # copies: nothing tells them apart
            return [(x, min(x + self.leaf, b)) for x in range(a, b, self.leaf)]
        here = np.where(self.lens[a:b] > depth, self.terms[np.minimum(self.starts[a:b] + depth, len(self.terms) - 1)], -1)
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(here))).tolist(), b]
        out: list[list[int]] = []
        for x, y in zip(cuts, cuts[1:]):
            if out and y - out[-1][0] <= self.leaf:
                out[-1][1] = y
            else:
                out.append([x, y])
        return [(x, y) for x, y in out]

    def add(self, a: int, b: int, kids) -> int:
        if kids is None:
            terms, tfs, m = self.terms[self.starts[a] : self.starts[b]], self.tfs[self.starts[a] : self.starts[b]], self.m[a:b].min()
        else:
            terms, tfs = (np.concatenate([self.kept[k][i] for k in kids]) for i in (0, 1))
            m = min(self.kept[k][2] for k in kids)
        by = np.lexsort((tfs, terms))
        end = np.append(np.diff(terms[by]) != 0, True)
        terms, tfs = terms[by][end], tfs[by][end]
        self.scratch[terms] = self.items.gains(terms, tfs, m)
        self.bounds.append(np.add.reduceat(self.scratch[self.items.flat], self.items.starts))
        self.scratch[terms] = 0
        self.kept.append((terms, tfs, m))
        self.nodes.append((a, b, kids))
        return len(self.nodes) - 1

    def search(self, item: int, held: "Best", member: np.ndarray, ids: np.ndarray, null: np.ndarray) -> int:
        """Offer the item's documents to ``held``; returns how many were scored."""
        stack, scored = [self.root], 0
        member[self.items.terms[item]] = True
        while stack:
            v = stack.pop()
            if self.bounds[v][item] < held.bar:
                continue
            a, b, kids = self.nodes[v]
            if kids is not None:
                stack += sorted(kids, key=lambda k: self.bounds[k][item])
                continue
            lo, hi = self.starts[a], self.starts[b]
            scores = np.add.reduceat(np.where(member[self.terms[lo:hi]], self.gains[lo:hi], 0), self.starts[a:b] - lo)
            scored += b - a
            at = self.order[a:b]
            held.offer(scores, ids[at], null[at])
        member[self.items.terms[item]] = False
        return scored


class Best:
    """The best rows of an item so far, by score, then id, null ids last; ``bar``: scores below it change nothing."""

    def __init__(self, top: int):
        self.top, self.bar = top, 1
        self.rows = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool))

    def offer(self, scores, ids, null) -> None:
        good = scores >= self.bar
        if not good.any():
            return
        s, i, z = (np.concatenate((old, new[good])) for old, new in zip(self.rows, (scores, ids, null)))
        by = np.lexsort((i, z, -s))[: self.top]
        self.rows = s[by], i[by], z[by]
        if len(by) == self.top:
            self.bar = int(self.rows[0][-1])


def search(vecs: DataFrame, items: Items, top: int = TOP, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """(item, score, doc_id): at most ``top`` rows per item and task; item is the number of the item in its slice."""

    def blocks(batches):
        held, rows, postings = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                held.append(part)
                rows += part.num_rows
                postings += pc.sum(pc.list_value_length(part.column("terms"))).as_py()
                if rows >= tree or postings >= POSTINGS:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, rows, postings = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        best = [Best(top) for _ in items.terms]
        member = np.zeros(len(items.weights), bool)
        for t in blocks(batches):
            ids = t.column("doc_id")
            null = np.asarray(ids.is_null())
            ids = ids.fill_null(LAST).to_numpy()
            lens, terms, tfs = (f(t.column(c)).to_numpy() for f, c in ((pc.list_value_length, "terms"), (pc.list_flatten, "terms"), (pc.list_flatten, "tfs")))
            grown = Tree(items, t.column("n").to_numpy(), lens.astype(np.int64), terms, tfs, leaf)
            for k, held in enumerate(best):
                grown.search(k, held, member, ids, null)
        for k, held in enumerate(best):
            s, i, z = held.rows
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k, np.int32)), pa.array(s), pa.array(i, mask=z)], names=["item", "score", "doc_id"])

    return vecs.mapInArrow(run, "item INT, score LONG, doc_id LONG")


def slices(benchmark: DataFrame, limit: int = SLICE):
    """Lists of (item_id, terms), each with at most ``limit`` bytes of text or one item; one list is on the driver at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        text = (r.t or "").encode()
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((r.i, {w for words in terms_of(text) for w in words}))
        size += len(text)
    if held:
        yield held


def ranked(docs: DataFrame, benchmark: DataFrame, top: int = TOP, limit: int = SLICE, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's ``top`` documents over all of ``docs``."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id LONG, rank INT, doc_id LONG, score LONG")
    for part in slices(benchmark, limit):
        part = [(i, terms) for i, terms in part if terms]
        vocabulary = {w: k for k, w in enumerate(sorted(set().union(*(terms for _, terms in part))))}
        if not vocabulary:
            continue
        vecs = stage(vectors(docs, vocabulary), "fp-vectors")
        documents, tokens = vecs.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for t, k in vecs.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as the slice has terms
            df[t] = k
        items = Items([np.array([vocabulary[w] for w in sorted(terms)], np.int64) for _, terms in part], df, documents, tokens)
        found = search(vecs.where(F.size("terms") > 0), items, top, tree, leaf).withColumn("salt", F.spark_partition_id() % 64)
        best = [F.desc("score"), F.asc_nulls_last("doc_id")]
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).where(F.col("rank") <= top)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(part)], "item INT, item_id LONG")
        out = out.unionByName(stage(found.join(names, "item").select("item_id", "rank", "doc_id", "score"), "fp-ranked"))
    return out


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return ranked(docs, benchmark)


def oracle(top: int = TOP) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS t FROM documents),
i AS (SELECT k, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS k, item_id, {words} AS t FROM benchmark)),
x AS (SELECT count(*) AS docs, sum(len(t)) AS tokens FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), x),
s AS (SELECT k, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens)))) AS BIGINT) AS score
      FROM i JOIN p USING (term) JOIN w USING (term), x GROUP BY k, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= {top}"""
