"""Weak supervision of text quality: rules vote or abstain, EM estimates how far each can be trusted.

Every rule looks at one statistic of the whole text and votes good (1), bad (-1) or abstains (0). Votes are counted per
pattern over all documents (at most 3 ** 11 rows, whatever the input), and expectation-maximisation on those counts
gives the share of good documents and of each kind of junk and, for each rule, the probability of each vote. A
document stays if the posterior probability of good given its votes reaches ``THRESHOLD`` and the base filter passes.

Defined results: a null text has no words; repeated rows are judged one by one; an empty table gives an empty result;
texts of any length are judged whole; a posterior equal to the threshold keeps; filtering keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage, utf8

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
_NOT_START = bytes(range(0x80, 0xC0)) + SPACE
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_RUNS = re.compile(rb"[#*$%&|<>]+")
THRESHOLD = 0.5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(width))))
    if len(set(grams)) == n:
        return 0
    count = Counter(grams)
    many = np.fromiter((count[g] > 1 for g in grams), np.int8, n)
    cover = np.zeros(len(words) + 1, np.int32)
    cover[:n] += many
    cover[width : width + n] -= many
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: bytes) -> tuple:
    """The base counts and what the rules look at besides."""
    words = text.split()
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    n = len(words)
    return (
        n, len(text.translate(None, _NOT_START)), len(text) - len(text.translate(None, SYMBOLS)),
        len(filled) - len(set(filled)), repeated_words(words), len(_RUNS.findall(text)), len(text) - len(text.translate(None, _PUNCTUATION)),
        len(filled), len(text) - len(text.translate(None, _UPPER)), text.count(b"!"),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"', b":", b";") for x in filled), len(set(words)),
    )


#: Distinct words of running text, factor and exponent over its words (Heaps' law): variety is judged alike at every length.
HEAPS = (2.5, 0.75)


def _rules(m: dict) -> list[tuple[str, str, np.ndarray, np.ndarray]]:
    """(kind of junk, name, votes bad, votes good) from the arrays of ``measure``; neither is an abstention.

    Each kind is seen by two rules or more: their agreement is what lets EM tell how often they are right.
    """
    w, lines, chars = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1), np.maximum(m["word_chars"], 1)
    symbols, runs, marks = m["n_symbols"] / w, m["n_runs"] / w, m["n_marks"] / chars
    length, ended = m["word_chars"] / w, m["n_ended"] / lines
    dup, rep = m["n_dup_lines"] / lines, m["n_repeat_words"] / w
    upper, bang = m["n_upper"] / chars, m["n_bang"] / w
    long, variety = m["n_words"] >= 50, m["n_kinds"] / (HEAPS[0] * w ** HEAPS[1])
    return [
        ("symbols", "symbols", symbols > 0.1, symbols < 0.02),
        ("symbols", "symbol_runs", runs > 0.08, runs < 0.02),
        ("symbols", "punctuation", marks > 0.12, marks < 0.08),
        ("repetition", "duplicate_lines", dup > 0.3, (dup == 0) & (m["n_lines"] >= 3)),
        ("repetition", "repetition", rep > 0.15, (rep < 0.03) & long),
        ("repetition", "variety", (variety < 0.3) & long, variety > 0.5),
        ("shouting", "capitals", upper > 0.3, upper < 0.1),
        ("shouting", "exclamation", bang > 0.1, (bang < 0.02) & long),
        ("structure", "word_length", (length < 2.5) | (length > 14), (length >= 3) & (length <= 12)),
        ("structure", "line_ends", ended < 0.2, ended > 0.6),
        ("structure", "word_count", m["n_words"] < 10, m["n_words"] >= 30),
    ]


NAMES = [*STATS, "n_runs", "n_marks", "n_lines", "n_upper", "n_bang", "n_ended", "n_kinds"]
_RULES = [r[:2] for r in _rules({k: np.zeros(1) for k in NAMES})]
N_RULES = len(_RULES)
#: Hidden classes: good, then one kind of bad document each.
CLASSES = ["good", *dict.fromkeys(kind for kind, _ in _RULES)]


def vote_codes(m: dict) -> np.ndarray:
    """One base-3 number per document: digit 0 abstains, 1 bad, 2 good."""
    code = np.zeros(len(m["n_words"]), np.int64)
    for _, _, bad, good in _rules(m):
        code = code * 3 + np.where(bad, 1, np.where(good, 2, 0))
    return code


def _digits(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(N_RULES - 1, -1, -1)) % 3


def judged(texts: list[bytes]) -> dict:
    rows = [measure(t) for t in texts]
    m = {k: np.array(v, np.int64) for k, v in zip(NAMES, zip(*rows))} if rows else {k: np.zeros(0, np.int64) for k in NAMES}
    m["base_failed"] = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    m["votes"] = vote_codes(m)
    return m


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and the vote pattern of every document."""
    names = [*STATS, "base_failed", "votes"]

    def run(batches):
        for b in small(batches):
            m = judged(utf8(b["text"]))
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), *(pa.array(m[k]) for k in names)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id LONG, " + ", ".join(f"{k} LONG" for k in STATS) + ", base_failed BOOLEAN, votes LONG")


def _joint(codes: np.ndarray, prior: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """log P(class, votes), one row per pattern."""
    return np.log(theta)[np.arange(N_RULES)[None, :], :, _digits(codes)].sum(1) + np.log(prior)


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = 500, tol: float = 1e-10):
    """Class shares, and vote probabilities of shape (rule, class, vote), from pattern counts.

    A bad document is bad in some way, so the hidden class is good or one kind of junk. Estimation starts from rules
    that are right four times in five about their own kind and see nothing in the others; add-one smoothing keeps every
    probability above zero. A rule's accuracy is its chance of voting bad for its kind and good for good documents, given
    that it votes; an abstention says nothing about the class.
    """
    votes, total = _digits(codes), counts.sum()
    hot = np.stack([votes == v for v in range(3)], -1).astype(float)  # pattern, rule, vote
    hot[..., 0] = 0
    theta = np.tile(np.array([1, 0.2, 0.8]), (N_RULES, len(CLASSES), 1))
    for r, (kind, _) in enumerate(_RULES):
        theta[r, CLASSES.index(kind)] = [1, 0.8, 0.2]
    prior, last = np.array([0.8, *[0.2 / (len(CLASSES) - 1)] * (len(CLASSES) - 1)]), -np.inf
    for _ in range(rounds):
        logp = _joint(codes, prior, theta)
        top = logp.max(1, keepdims=True)
        like = np.exp(logp - top)
        score = float((counts * (top[:, 0] + np.log(like.sum(1)))).sum())
        weight = like / like.sum(1, keepdims=True) * counts[:, None]
        cast = np.einsum("pc,prv->rcv", weight, hot) + 1
        theta = cast / cast[..., 1:].sum(-1, keepdims=True)
        theta[..., 0] = 1
        prior = (weight.sum(0) + 1) / (total + len(CLASSES))
        if abs(score - last) <= tol * max(1.0, abs(score)):
            break
        last = score
    return prior, theta


def posterior(codes: np.ndarray, prior: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(good | votes)."""
    logp = _joint(codes, prior, theta)
    like = np.exp(logp - logp.max(1, keepdims=True))
    return like[:, 0] / like.sum(1)


def fit(patterns: DataFrame):
    """EM on the counts per vote pattern; the rows brought to the driver are bounded by 3 ** N_RULES = 177,147."""
    rows = patterns.groupBy("votes").count().collect()
    rows = sorted((r["votes"], r["count"]) for r in rows)
    codes, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    return expectation_maximisation(codes, counts)


def judge(stats: DataFrame, prior: np.ndarray, theta: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``stats`` with ``quality`` (the posterior) and ``kept``."""
    names = stats.columns

    def run(batches):
        for b in small(batches):
            p = posterior(np.asarray(b["votes"]), prior, theta) if b.num_rows else np.zeros(0)
            kept = (p >= threshold) & ~np.asarray(b["base_failed"].to_pylist(), bool)
            yield pa.record_batch([*(b[c] for c in names), pa.array(p, pa.float64()), pa.array(kept, pa.bool_())], [*names, "quality", "kept"])

    return stats.mapInArrow(run, stats.select("*", F.lit(0.0).alias("quality"), F.lit(True).alias("kept")).schema)


def filter_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Texts are measured once to count votes, once to decide."""
    prior, theta = fit(measured(docs))
    names = docs.columns

    def run(batches):
        for b in small(batches):
            m = judged(utf8(b["text"]))
            kept = (posterior(m["votes"], prior, theta) >= threshold) & ~m["base_failed"] if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b[i] for i in range(len(names))], names).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    stats = stage(measured(docs), "quality-stats")
    prior, theta = fit(stats)
    return judge(stats, prior, theta).select("doc_id", *STATS, "base_failed", "kept", "quality")
