"""Katz backoff bigram model: Good-Turing discounted counts, exactly normalised backoff weights, partitioned tables.

Tables
    unigrams   per word shard: words, their counts and numbers
    bigrams    per pair shard: (history, word, count), and per history what its backoff weight is made of
Both are written before anything is scored. A token is evaluated recursively: by its discounted bigram if that was seen
in training, else by the history's backoff weight times the unigram, whose own left-over mass is the unknown word's.

Movement
    Documents form blocks. A block sends its distinct words to word shards and gets counts back; then it sends its
    distinct pairs to pair shards and gets counts and history statistics back. Frequent words and pairs are one entry
    per block. A history with more than 1 / ``HOT`` of all training tokens is spread over the pair shards by its words;
    there are at most ``HOT`` of these, and their summed statistics are broadcast.

Every document is the sequence of its lower-cased words and one end; the history of its first token is the end.

Defined results: null and empty texts are one end; a word that training has not seen is the unknown word; repeated rows
are scored row by row, and each counts in training; without training rows every token has probability 1;
texts of any length are scored whole; ties in the order of words change no result; an empty table gives no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import fold_of, pack, pack_words, stage, unpack, unpack_words

END = b""
TEST_FOLD = 1
MAX_R = 5
HOT = 65_536
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def good_turing(n: np.ndarray) -> np.ndarray:
    """Discounts d[0..MAX_R + 1] from n[r] = number of events seen r times (r = 1 … MAX_R + 1); counts above are kept.

    Where the counts of counts are too few for Katz's formula, absolute discounting n1 / (n1 + 2 n2) takes its place.
    """
    d = np.ones(MAX_R + 2)
    n = np.asarray(n, float)
    if n[1] > 0 and (n[1 : MAX_R + 2] > 0).all():
        share = (MAX_R + 1) * n[MAX_R + 1] / n[1]
        r = np.arange(1, MAX_R + 1)
        got = ((r + 1) * n[r + 1] / (n[r] * r) - share) / (1 - share) if share != 1 else np.full(MAX_R, -1.0)
        if (got > 0).all() and (got < 1).all():
            d[1 : MAX_R + 1] = got
            return d
    if n[1] > 0:
        d[1 : MAX_R + 1] = 1 - n[1] / (n[1] + 2 * n[2]) / np.arange(1, MAX_R + 1) * (1 if n[2] > 0 else 0.5)
    return d


class Unigrams(NamedTuple):
    total: int
    kinds: int
    discount: np.ndarray
    scale: float
    unknown: float

    @classmethod
    def of(cls, total: int, kinds: int, n: np.ndarray, r_mass: np.ndarray) -> "Unigrams":
        """``r_mass``: training tokens in words seen r times (r = 0 … MAX_R)."""
        d = good_turing(n)
        if not total:
            return cls(0, 0, d, 1.0, 1.0)
        left = float(((1 - d[: MAX_R + 1]) * r_mass).sum() / total)
        scale = 1.0 if left > 0 else total / (total + 1)
        return cls(total, kinds, d, scale, left if left > 0 else 1 / (total + 1))

    def mass(self, c: np.ndarray) -> np.ndarray:
        """Discounted count; over ``total`` it is the probability of a known word."""
        return self.discount[np.minimum(c, MAX_R + 1).astype(np.int64)] * c * self.scale

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.mass(c) / max(1, self.total), self.unknown)


def backoff(count: np.ndarray, m: np.ndarray, mass: np.ndarray, discount: np.ndarray, uni: Unigrams):
    """(weight, scale) of histories: ``count`` training tokens, m[r] followers seen r times, unigram mass of followers.

    The weight shares what discounting leaves over the words that did not follow, so that all words sum to 1. A
    history whose counts are all above MAX_R has nothing left over: its counts are scaled by count / (count + 1).
    """
    r = np.arange(1, MAX_R + 1)
    left = ((1 - discount[1 : MAX_R + 1]) * r * m).sum(-1) / np.maximum(1, count)
    scale = np.where(left > 1e-12, 1.0, count / (count + 1.0))
    left = np.where(left > 1e-12, left, 1 / (count + 1.0))
    return left / np.maximum(1 - mass / max(1, uni.total), 1e-300), scale


class Pairs(NamedTuple):
    """Distinct (history, word) of a block, in the order in which they travel."""

    shard: np.ndarray
    history: np.ndarray  # numbers in the block
    word: np.ndarray
    token: np.ndarray  # of each token: its pair, or -1 where the history is unknown
    train: np.ndarray  # training occurrences


def pairs_of(tokens: np.ndarray, lens: np.ndarray, train: np.ndarray, number: np.ndarray, count: np.ndarray, end: int, shards: int, hot_above: float) -> Pairs:
    """Pairs with a known history. ``number`` and ``count`` are the global number and the training count of each word."""
    tokens = tokens.astype(np.int64)
    history = np.empty_like(tokens)
    history[1:] = tokens[:-1]
    history[np.cumsum(lens) - lens] = end
    n_words = len(number)
    known = count[history] > 0
    key, inverse = np.unique(history[known] * n_words + tokens[known], return_inverse=True)
    h, w = key // max(1, n_words), key % max(1, n_words)
    gh, gw = number[h], number[w]
    mixed = np.where(count[h] > hot_above, gh ^ ((gw + np.uint64(1)) * _MIX), gh)
    shard = (((mixed + np.uint64(7)) * _MIX) >> np.uint64(24)) % np.uint64(shards)
    order = np.lexsort((gw, gh, shard))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    token = np.full(len(tokens), -1, np.int64)
    token[known] = back[inverse.reshape(-1)]
    seen = np.bincount(token[known & np.repeat(train, lens)], minlength=len(order))
    return Pairs(shard[order].astype(np.int64), h[order], w[order], token, seen)


def _runs(a: np.ndarray):
    """Start of each run of equal values in ``a``."""
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)


def pack_pairs(gh, gw, cw, seen) -> bytes:
    """Histories as runs; words through a list of the distinct ones, each with its count."""
    first = _runs(gh)
    kinds, at, index = np.unique(gw, return_index=True, return_inverse=True)
    cols = [np.diff(gh[first], prepend=np.uint64(0)), np.diff(first, append=len(gh)).astype(np.uint32),
            np.diff(kinds, prepend=np.uint64(0)), cw[at].astype(np.uint64), index.reshape(-1).astype(np.uint32), seen.astype(np.uint32)]
    return join_bytes([pack(c, 9) for c in cols])


def unpack_pairs(b: bytes):
    dh, runs, dw, cw, index, seen = map(unpack, split_bytes(b))
    return np.repeat(np.cumsum(dh), runs.astype(np.int64)), np.cumsum(dw)[index], cw[index].astype(np.int64), seen.astype(np.int64), runs.astype(np.int64)


def join_bytes(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def split_bytes(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 4], "little")
        out.append(b[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def train_flags(doc_ids) -> np.ndarray:
    return np.array([fold_of(i) != TEST_FOLD for i in doc_ids], bool)


def count_words(made: DataFrame, shards: B.Shards) -> DataFrame:
    """Answers with the count and the number of every word, and the unigram table of each shard."""

    def extra(row):
        lens = unpack(row["lens"]).astype(np.int64)
        tokens = unpack(row["tokens"])
        return np.bincount(tokens[np.repeat(train_flags(row["doc_ids"]), lens)], minlength=row["n_words"]).astype(np.uint32)

    def count(t: pa.Table) -> pa.Table:
        lists = [unpack_words(w) for w in t["words"].to_pylist()]
        words, index = B.word_index(lists)
        total = np.zeros(len(words), np.int64)
        for own, x in zip(index, t["extra"].to_pylist()):
            total[own] += unpack(x)
        shard = t["shard"][0].as_py()
        n = np.bincount(np.minimum(total, MAX_R + 2), minlength=MAX_R + 3)
        mass = np.bincount(np.minimum(total, MAX_R + 2), total, MAX_R + 3)
        head = np.array([total.sum(), (total > 0).sum(), *n[: MAX_R + 2], *mass[: MAX_R + 1].astype(np.int64)], np.int64)
        known = np.flatnonzero(total)
        table = join_bytes([pack_words([words[i] for i in known.tolist()]), pack(total[known].astype(np.uint64)), pack(known.astype(np.uint64))])
        out = [(shard, B.TABLE, head.tobytes(), table)]
        for block, at, own in zip(t["block"].to_pylist(), t["at"].to_pylist(), index):
            number = own.astype(np.uint64) * np.uint64(shards.count) + np.uint64(shard)
            out.append((block, 1, at, join_bytes([pack(total[own].astype(np.uint64)), pack(number)])))
        return B.answers(out)

    return B.send_words(made, shards, extra).groupBy("shard").applyInArrow(count, B.ANSWER)


def known_words(row: dict, found: list[dict]):
    number, count = np.zeros(row["n_words"], np.uint64), np.zeros(row["n_words"], np.int64)
    for a in found:
        c, g = map(unpack, split_bytes(a["answer"]))
        at = B.positions(a["at"])
        number[at], count[at] = g, c
    return number, count


class Scorer(NamedTuple):
    shards: int
    uni: Unigrams
    hot_above: float

    def pairs(self, row, number, count):
        lens = unpack(row["lens"]).astype(np.int64)
        return pairs_of(unpack(row["tokens"]), lens, train_flags(row["doc_ids"]), number, count, row["mark"], self.shards, self.hot_above), lens


PAIRS = "shard INT, block LONG, pairs BINARY"


def send_pairs(blocks: DataFrame, found: DataFrame, how: Scorer) -> DataFrame:
    def run(block: pa.Table, ans: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            number, count = known_words(row, ans.to_pylist())
            p, _ = how.pairs(row, number, count)
            cuts = np.searchsorted(p.shard, np.arange(how.shards + 1))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                at = slice(cuts[s], cuts[s + 1])
                out.append((s, row["block"], pack_pairs(number[p.history[at]], number[p.word[at]], count[p.word[at]], p.train[at])))
        cols = list(zip(*out)) if out else [(), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary()))], ["shard", "block", "pairs"])

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, PAIRS)


def count_pairs(sent: DataFrame, how: Scorer) -> DataFrame:
    """Answers with the count of each pair and the statistics of each history, and the bigram table of each shard."""

    def count(t: pa.Table) -> pa.Table:
        rows = [unpack_pairs(b) for b in t["pairs"].to_pylist()]
        gh, gw, cw, seen = (np.concatenate([r[k] for r in rows]) for k in range(4))
        order = np.lexsort((gw, gh))
        gh, gw, cw = gh[order], gw[order], cw[order]
        first = np.flatnonzero(np.r_[True, (gh[1:] != gh[:-1]) | (gw[1:] != gw[:-1])])
        total = np.add.reduceat(seen[order], first)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(gh)))
        uh, uw, uc = gh[first], gw[first], cw[first]
        begin = _runs(uh)
        r = np.minimum(total, MAX_R + 1)
        m = [np.add.reduceat((r == k).astype(np.int64), begin) for k in range(1, MAX_R + 1)]
        mass = np.add.reduceat(np.where(total > 0, how.uni.mass(uc), 0.0), begin)
        history = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(uh)))
        n = np.bincount(np.minimum(total, MAX_R + 2), minlength=MAX_R + 3)[: MAX_R + 2]
        known = total > 0
        kept = np.flatnonzero(known)
        hot = np.flatnonzero(np.add.reduceat(total, begin) > 0)
        table = join_bytes([pack(uh[kept]), pack(uw[kept]), pack(total[kept].astype(np.uint64)), pack(uh[begin][hot]),
                            *(pack(x[hot].astype(np.uint32)) for x in m), mass[hot].tobytes()])
        out = [(t["shard"][0].as_py(), B.TABLE, n.astype(np.int64).tobytes(), table)]
        at = 0
        for block, (_, _, _, own, runs) in zip(t["block"].to_pylist(), rows):
            g = group[at : at + len(own)]
            at += len(own)
            h = history[g[np.cumsum(runs) - runs]]
            parts = [pack(total[g].astype(np.uint32)), *(pack(x[h].astype(np.uint32)) for x in m), pack(mass[h].view(np.uint64))]
            out.append((block, 2, t["shard"][0].as_py().to_bytes(4, "little"), join_bytes(parts)))
        return B.answers(out)

    return sent.groupBy("shard").applyInArrow(count, B.ANSWER)


def hot_histories(table: DataFrame, hot: list[int]) -> dict[int, np.ndarray]:
    """Statistics of the histories that are spread over the shards, summed by Spark: at most HOT rows come back."""
    if not hot:
        return {}
    wanted = np.array(sorted(hot), np.uint64)

    def run(batches):
        for b in batches:
            out = []
            for a in b["answer"].to_pylist():
                parts = split_bytes(a)
                h = unpack(parts[3])
                hit = np.flatnonzero(np.isin(h, wanted))
                m = [unpack(x)[hit] for x in parts[4 : 4 + MAX_R]]
                mass = np.frombuffer(parts[4 + MAX_R])[hit]
                out += [(int(h[i]), *(int(x[k]) for x in m), float(mass[k])) for k, i in enumerate(hit.tolist())]
            cols = list(zip(*out)) if out else [()] * (MAX_R + 2)
            kinds = [pa.int64()] * (MAX_R + 1) + [pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["h", *(f"m{k}" for k in range(1, MAX_R + 1)), "mass"])

    names = [f"m{k}" for k in range(1, MAX_R + 1)]
    rows = table.select("answer").mapInArrow(run, "h LONG, " + ", ".join(f"{n} LONG" for n in names) + ", mass DOUBLE")
    rows = rows.groupBy("h").agg(*(F.sum(n).alias(n) for n in [*names, "mass"])).collect()
    return {r.h: np.array([*(r[n] for n in names), r.mass]) for r in rows}


SCORES = "doc_id LONG, held_out BOOLEAN, n_tokens LONG, n_known LONG, train_tokens LONG, base_score DOUBLE, score DOUBLE"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def token_probabilities(p: Pairs, tokens, number, count, found: list[dict], how: Scorer, discount, hot: dict[int, np.ndarray]) -> np.ndarray:
    """P(token | history) of every token, by the recursion of the module's head."""
    uni = how.uni
    seen, m, mass = np.zeros(len(p.shard), np.int64), np.zeros((len(p.shard), MAX_R), np.int64), np.zeros(len(p.shard))
    cuts = np.searchsorted(p.shard, np.arange(how.shards + 1))
    for a in found:
        s = int.from_bytes(a["at"], "little")
        at = slice(cuts[s], cuts[s + 1])
        parts = split_bytes(a["answer"])
        seen[at] = unpack(parts[0])
        runs = _runs(p.history[at])
        n = np.diff(runs, append=cuts[s + 1] - cuts[s])
        for k in range(MAX_R):
            m[at, k] = np.repeat(unpack(parts[1 + k]).astype(np.int64), n)
        mass[at] = np.repeat(unpack(parts[1 + MAX_R]).view(np.float64), n)
    own = np.flatnonzero(count[p.history] > how.hot_above)
    if len(own):
        names = np.array(sorted(hot), np.uint64)
        stats = np.array([hot[n] for n in names.tolist()])[np.searchsorted(names, number[p.history[own]])]
        m[own], mass[own] = stats[:, :MAX_R].astype(np.int64), stats[:, MAX_R]
    c = count[p.history]
    weight, scale = backoff(c, m, mass, discount, uni)
    direct = discount[np.minimum(seen, MAX_R + 1)] * seen / np.maximum(1, c) * scale
    low = uni.probability(count)
    by_pair = np.where(seen > 0, direct, weight * low[p.word])
    return np.where(p.token >= 0, by_pair[p.token] if len(by_pair) else 0.0, low[tokens.astype(np.int64)])


def score_blocks(blocks: DataFrame, found: DataFrame, how: Scorer, discount: np.ndarray, hot) -> DataFrame:
    def run(block: pa.Table, ans: pa.Table) -> pa.Table:
        out, uni = [], how.uni
        for row in block.to_pylist():
            every = ans.to_pylist()
            number, count = known_words(row, [a for a in every if a["kind"] == 1])
            p, lens = how.pairs(row, number, count)
            tokens = unpack(row["tokens"]).astype(np.int64)
            probability = token_probabilities(p, tokens, number, count, [a for a in every if a["kind"] == 2], how, discount, hot.value)
            first = np.cumsum(lens) - lens
            score = np.add.reduceat(np.log10(probability), first)
            base = np.add.reduceat(np.log10((count[tokens] + 0.5) / (uni.total + 0.5 * (uni.kinds + 1))), first)
            known = np.add.reduceat((count[tokens] > 0).astype(np.int64), first)
            held = ~train_flags(row["doc_ids"])
            out.append(pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(held), pa.array(lens), pa.array(known), pa.array(np.full(len(lens), uni.total)),
                                 pa.array(base), pa.array(score)], schema=_SCORES))
        return pa.concat_tables(out) if out else _SCORES.empty_table()

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, SCORES)


class Model(NamedTuple):
    blocks: DataFrame
    words: DataFrame
    pairs: DataFrame
    how: Scorer
    discount: np.ndarray
    hot: dict[int, np.ndarray]

    def scores(self) -> DataFrame:
        hot = self.blocks.sparkSession.sparkContext.broadcast(self.hot)
        found = self.words.where(F.col("kind") == 1).unionByName(self.pairs.where(F.col("kind") == 2))
        return score_blocks(self.blocks, found, self.how, self.discount, hot)


def _sums(tables: DataFrame, n: int) -> np.ndarray:
    """Sums of the shards' heads, n numbers each, added up by Spark."""

    def run(batches):
        total = sum((np.frombuffer(x, np.int64) for b in batches for x in b["at"].to_pylist()), np.zeros(n, np.int64))
        yield pa.record_batch([pa.array(np.arange(n)), pa.array(total)], ["k", "v"])

    out = np.zeros(n, np.int64)
    for r in tables.select("at").mapInArrow(run, "k LONG, v LONG").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def build(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES) -> Model:
    made = stage(B.make_blocks(docs, split, block_bytes, mark=END), "katz-blocks")
    shards = B.shards_for(made)
    words = stage(count_words(made, shards), "katz-unigrams")
    head = _sums(words.where(F.col("kind") == B.TABLE), 2 + (MAX_R + 2) + (MAX_R + 1))
    uni = Unigrams.of(int(head[0]), int(head[1]), head[2 : MAX_R + 4], head[MAX_R + 4 :])
    how = Scorer(2 * shards.count, uni, uni.total / HOT)
    blocks = made.select("block", "doc_ids", "lens", "tokens", "n_words", "mark")
    pairs = stage(count_pairs(send_pairs(blocks, words.where(F.col("kind") == 1), how), how), "katz-bigrams")
    tables = pairs.where(F.col("kind") == B.TABLE)
    discount = good_turing(_sums(tables, MAX_R + 2))
    hot = [n for n, c in frequent_words(words.where(F.col("kind") == B.TABLE), shards.count, how.hot_above)]
    return Model(blocks, words, pairs, how, discount, hot_histories(tables, hot))


def frequent_words(tables: DataFrame, shards: int, above: float) -> list[tuple[int, int]]:
    """(number, count) of the words with more than ``above`` training tokens: at most HOT rows."""

    def run(batches):
        for b in batches:
            number, count = [], []
            for shard, a in zip(b["block"].to_pylist(), b["answer"].to_pylist()):
                c, numbers = (unpack(x).astype(np.int64) for x in split_bytes(a)[1:3])
                hit = np.flatnonzero(c > above)
                number += (numbers[hit] * shards + shard).tolist()
                count += c[hit].tolist()
            yield pa.record_batch([pa.array(number, pa.int64()), pa.array(count, pa.int64())], ["number", "n"])

    return [(r.number, r.n) for r in tables.select("block", "answer").mapInArrow(run, "number LONG, n LONG").collect()]


def query(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    return build(docs, block_bytes).scores()
