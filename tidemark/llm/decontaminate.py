"""Benchmark decontamination by the q-gram lemma: filter by shared q-grams in diagonal bands, verify by alignment.

Text and items are lower-cased and every run of white space becomes one space. An item of m characters is found in a
document if some part of the document is within k = m * ``EDIT_RATE`` edits of the whole item. Such a part shares at
least m + 1 - q (k + 1) of the item's q-grams, and their diagonals (place in the document minus place in the item) differ
by at most k. Diagonals are counted in bins of k + 1; two neighbouring bins are one of the overlapping bands, so a band
that holds the whole alignment always exists. Bands that meet the bound, with distinct q-grams of the item on k + 1 diagonals,
are verified by banded alignment.

Items are broadcast in blocks of at most ``BLOCK_CHARS`` characters (plus one item), every block against all documents.

Defined results: null and empty texts hold no item; items shorter than q characters are found as they are between
word boundaries, and k is lowered for short items until the bound is at least one shared q-gram; items with a null id keep it; repeated documents are
reported row by row; texts of any length are searched whole; of places with equally few edits the first is reported; without
documents or items nothing is found, and cleaning keeps all rows; cleaning keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage, utf8

Q = 8
EDIT_RATE = 0.1
BLOCK_CHARS = 4_000_000
#: Characters of documents that are scanned at once.
BATCH_CHARS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Places that are no inside of a word, where a short item may begin.
_START = re.compile(r"(?<!\w)\S|(?<=\w)[^\w\s]")
_GAP = "￿" * Q


def normal(text: bytes) -> str:
    return " ".join(text.decode("utf-8", "replace").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(points: np.ndarray) -> np.ndarray:
    """Every q-gram as one number, eight bits a character: equal q-grams have equal numbers."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    one = ((points ^ (points >> 8) * 31) & 0xFF).astype(np.uint16)
    two = one[:-1] | one[1:] << 8
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    return four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)


def inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def edit_budget(m: int) -> int:
    return min(int(m * EDIT_RATE), (m - Q) // Q)


class Index:
    """The q-grams of a block of items, behind a bitmap of their hashes."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.points = [code_points(t) for t in self.texts]
        m = np.array([len(p) for p in self.points], np.int64)
        self.k = np.array([edit_budget(x) for x in m.tolist()], np.int64)
        self.need = m + 1 - Q * (self.k + 1)
        self.short: dict[str, list[int]] = {}
        for i, t in enumerate(self.texts):
            if len(t) < Q:
                self.short.setdefault(t, []).append(i)
        self.short_lens = sorted({len(t) for t in self.short})
        every = [grams(p) for p in self.points]
        n = np.array([len(g) for g in every], np.int64)
        codes = np.concatenate(every) if every else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(items)), n)
        place = np.concatenate([np.arange(x) for x in n.tolist()]) if len(n) else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first = np.unique(codes[order], return_index=True)
        self.last = np.append(self.first[1:], len(codes))
        self.bits = min(28, max(16, int(np.ceil(np.log2(max(1, len(self.codes))))) + 5))
        self.shift = np.uint64(64 - self.bits)
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[(self.codes * _MIX) >> self.shift] = True

    def exact(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the short items between word boundaries."""
        for m in _START.finditer(text) if self.short else ():
            s = m.start()
            for n in self.short_lens:
                e = s + n
                items = self.short.get(text[s:e]) if e <= len(text) else None
                if items and (e == len(text) or not (inside(text[e - 1]) and inside(text[e]))):
                    yield from ((i, s, e) for i in items)

    def bands(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(item, bin) of every band whose shared q-grams meet the item's bound."""
        if not len(self.codes):
            return []
        at = np.flatnonzero(self.bitmap[(codes * _MIX) >> self.shift])
        g = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        hit = self.codes[g] == codes[at]
        at, g = at[hit], g[hit]
        n = self.last[g] - self.first[g]
        at = np.repeat(at, n)
        occ = np.arange(len(at)) + np.repeat(self.first[g] - (np.cumsum(n) - n), n)
        item, place = self.item[occ], self.place[occ]
        low = at - place
        key = item * (1 << 40) + ((low + (1 << 20)) // (self.k[item] + 1))
        order = np.lexsort((low, key))
        key, low, place = key[order], low[order], place[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(key)]
        name = key[first]
        joined = np.zeros(len(name), bool)
        joined[:-1] = name[1:] == name[:-1] + 1
        end = np.where(joined, np.r_[last[1:], 0], last)
        item = name >> 40
        out = []
        for c in np.flatnonzero(end - first >= self.need[item]).tolist():
            a, z, i = first[c], end[c], int(item[c])
            if self._dense(low[a:z], place[a:z], int(self.k[i]), int(self.need[i])):
                out.append((i, int(name[c]) & ((1 << 40) - 1)))
        return out

    @staticmethod
    def _dense(low: np.ndarray, place: np.ndarray, k: int, need: int) -> bool:
        """Whether some k + 1 neighbouring diagonals share ``need`` different q-grams of the item (``low`` ascends)."""
        if len(np.unique(place)) < need:
            return False
        right = np.searchsorted(low, low + k, "right")
        for a in np.flatnonzero(right - np.arange(len(low)) >= need).tolist():
            if len(np.unique(place[a : right[a]])) >= need:
                return True
        return False

    def origin(self, item: int, b: int) -> int:
        """The smallest diagonal of a bin."""
        return b * (int(self.k[item]) + 1) - (1 << 20)


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int):
    """(edits, start, end) of the best part of ``text`` with at most k edits to the whole pattern, on diagonals low..high.

    Row by row over the pattern; column c of a row is text place row + low + c. The start of the best alignment is
    carried along, so that no table is kept.
    """
    width, m, n, big = high - low + 1, len(pattern), len(text), 1 << 20
    column = np.arange(width)
    place = low + column
    cost = np.where((place >= 0) & (place <= n), 0, big)
    start = place.copy()
    for i in range(m):
        place = i + 1 + low + column  # text characters used after this row
        inside = (place >= 1) & (place <= n)
        same = np.zeros(width, np.int64)
        same[inside] = text[place[inside] - 1] != pattern[i]
        same[~inside] = big
        new, origin = cost + same, start.copy()
        drop = np.append(cost[1:], big) + 1  # a pattern character without counterpart: the diagonal falls by one
        better = drop < new
        new[better], origin[better] = drop[better], np.append(start[1:], 0)[better]
        new = np.where((place >= 0) & (place <= n), new, big)
        run = new - column  # text characters without counterpart: cost 1 a column from the best column before
        best = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == best, column, 0))
        cost, start = best + column, origin[source]
        cost = np.where((place >= 0) & (place <= n), cost, big)
        if cost.min() > k:
            return None
    at = int(cost.argmin())
    return int(cost[at]), int(start[at]), int(m + low + at)


def found(index: Index, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """Per text: (item, edits, start, end) of every verified place; places of one item do not overlap."""
    points = code_points(_GAP.join(texts))
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens + len(_GAP)) - len(_GAP)
    first = ends - lens
    out: list[list] = [[] for _ in texts]
    seen: list[dict] = [{} for _ in texts]
    for item, b in index.bands(grams(points)):
        k, m = int(index.k[item]), len(index.points[item])
        low, high = index.origin(item, b) - k, index.origin(item, b) + 3 * k + 2
        doc = int(np.searchsorted(first, max(0, low + k + m // 2), "right")) - 1
        for d in {max(0, doc - 1), doc, min(len(texts) - 1, doc + 1)}:  # the band may touch a neighbour
            a, z = int(first[d]), int(ends[d])
            if high + m < a or low > z or z == a:
                continue
            s, e = max(a, low), min(z, high + m + k)
            at = texts[d].find(index.texts[item], s - a, e - a)
            if at >= 0:
                hit = (0, at, at + m)
            else:
                hit = banded(index.points[item], points[a:z], low - a, high - a, k)
            if hit and hit[0] <= k:
                seen[d].setdefault(item, set()).add(hit)
    for d, text in enumerate(texts):
        for item, s, e in index.exact(text):
            seen[d].setdefault(item, set()).add((0, s, e))
    for d, items in enumerate(seen):
        for item, hits in items.items():
            kept: list[tuple] = []
            for edits, s, e in sorted(hits):
                if all(e <= x or s >= y for _, x, y in kept):
                    kept.append((edits, s, e))
            out[d] += [(item, *h) for h in kept]
    return out


def in_batches(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def scan(index: Index, texts: list[bytes]) -> list[list[tuple]]:
    return [hits for part in in_batches([normal(t) for t in texts]) for hits in found(index, part)]


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, one after the other."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).distinct().collect()
        made = [(r.item_id, normal(r.text.encode())) for r in rows]
        made = sorted((x for x in made if x[1]), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if made:
            yield made


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start_char, end_char of every item found; places are in the normalised text."""
    schema = "doc_id LONG, item_id LONG, edits INT, start_char LONG, end_char LONG"
    out = docs.sparkSession.createDataFrame([], schema)
    rows = docs.select("doc_id", "text")
    for items in blocks_of(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            index = Index(sent.value)
            for b in small(batches):
                got = [(doc, index.ids[i], e, s, z) for doc, hits in zip(b["doc_id"].to_pylist(), scan(index, utf8(b["text"]))) for i, e, s, z in hits]
                cols = list(zip(*got)) if got else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "edits", "start_char", "end_char"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; narrow passes, one per block of items.

    Rows are staged between the passes, so that the workers hold one block's index at a time.
    """
    names = docs.columns
    for k, items in enumerate(blocks_of(benchmark)):
        docs = stage(docs, "clean") if k else docs
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            index = Index(sent.value)
            for b in small(batches):
                keep = [not hits for hits in scan(index, utf8(b["text"]))]
                yield pa.RecordBatch.from_arrays([b[i] for i in range(len(names))], names).filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: places, and the edits of the closest one."""
    return matches(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.min("edits").alias("edits"), F.count("*").alias("n_places"), F.min("start_char").alias("first_char"))
