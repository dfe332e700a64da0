"""Quality by compression: zstd dictionaries of good and of bad text, and a calibrated difference of compressed sizes.

A text is cut into pieces of ``PIECE`` bytes, so that a dictionary counts alike in short and in long texts; every piece is
compressed with the good dictionary, with the bad one and with none. The normalised difference (bad - good) / none, its
extremes over the pieces and the three rates are calibrated by a quadratic logistic regression to the probability of
label 1. Nothing but the text enters a score.

Training takes a bounded sample of the labelled rows: at most ``SAMPLE`` documents of each label, those whose ids have
the smallest hashes; of a dictionary document at most ``DICTIONARY_PIECES`` pieces become dictionary content, drawn over its
whole length by the hashes of their numbers.
One half of the sample makes the dictionaries, the other half the calibration.

Defined results: null and empty texts are scored as one empty piece; a document whose labels disagree is not learned from;
where a label is missing altogether every score is the share of label 1 among the labelled rows (0.5 if there are none);
texts of any length are scored whole, piece by piece; of rows with one id the text with the smallest hash is learned from and
every row is scored; ties in the order of the sample go to the smaller id; an empty table gives no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, in_fold, small, utf8

SAMPLE = 3000
DICTIONARY_PIECES = 8
DICTIONARY_BYTES = 112 << 10
PIECE = 2048
#: Bytes of the runs that are kept where a text is thinned.
THIN = 64
CUT = 0.3


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; from smaller pieces where there are too few to train on, else the texts themselves, thinned alike over their whole length."""
    for piece in (PIECE, PIECE // 8):
        pieces = [t[i : i + piece] for t in texts for i in range(0, len(t), piece)]
        if len(pieces) > 8:
            try:
                return zstandard.train_dictionary(size, pieces).as_bytes()
            except zstandard.ZstdError:
                continue
    return thinned(texts, size)


def thinned(texts: list[bytes], size: int) -> bytes:
    """At most about ``size`` bytes: runs of ``THIN`` at even distances over all texts."""
    whole = b"\n".join(texts)
    every = max(1, -(-len(whole) // size))
    return b"".join(whole[i : i + THIN] for i in range(0, len(whole), THIN * every))


def drawn_pieces(doc_id: int, text: bytes, most: int = DICTIONARY_PIECES) -> bytes:
    """At most ``most`` pieces of the text, in their order; the same pieces wherever the row is read."""
    n = -(-len(text) // PIECE)
    if n <= most:
        return text
    at = sorted(sorted(range(n), key=lambda k: xxhash.xxh3_64_intdigest(f"{doc_id} {k}"))[:most])
    return b"".join(text[k * PIECE : (k + 1) * PIECE] for k in at)


def sampled(docs: DataFrame) -> DataFrame:
    """label, doc_id and the drawn pieces of every row."""

    def run(batches):
        for b in small(batches):
            parts = [drawn_pieces(i, t) for i, t in zip(b["doc_id"].to_pylist(), utf8(b["text"]))]
            yield pa.record_batch([b["label"], b["doc_id"].cast(pa.int64()), pa.array(parts, pa.binary())], ["label", "doc_id", "pieces"])

    return docs.select("label", "doc_id", "text").mapInArrow(run, "label INT, doc_id LONG, pieces BINARY")


class Sizes:
    """Compressed sizes with each dictionary; compressors keep their state inside one task."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        kinds = [zstandard.ZstdCompressionDict(d) if d else None for d in (good, bad)]
        for d in kinds:
            if d:
                d.precompute_compress(level=3)
        self.each = [zstandard.ZstdCompressor(dict_data=d, **plain) if d else zstandard.ZstdCompressor(level=3, **plain) for d in kinds]
        self.each.append(zstandard.ZstdCompressor(level=3, **plain))

    def features(self, text: bytes) -> tuple:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [b""]
        s = np.array([[len(c.compress(p)) for c in self.each] for p in pieces], float)
        good, bad, none = s.sum(0)
        n, each = max(1, len(text)), (s[:, 1] - s[:, 0]) / s[:, 2]
        return (bad - good) / none, good / n, bad / n, none / n, each.min(), each.max()


class Calibration:
    """Logistic regression on standardised features and their products, fitted by Newton steps with a small ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60):
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-9
        z, self.w = self._expand(x), None
        w = np.zeros(z.shape[1])
        penalty = ridge * len(y) * np.r_[np.ones(len(w) - 1), 1e-9]
        for _ in range(steps):
            p = self._logistic(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.w = w

    @staticmethod
    def _logistic(v):
        return 1 / (1 + np.exp(-np.clip(v, -500, 500)))

    def _expand(self, x):
        # An outlier counts as six deviations, so that its square outweighs nothing.
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        first, second = np.triu_indices(z.shape[1])
        return np.column_stack([z, z[:, first] * z[:, second], np.ones(len(z))])

    def __call__(self, x):
        return self._logistic(self._expand(x) @ self.w)


def featured(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    def run(batches):
        sizes = Sizes(good, bad)
        for b in small(batches):
            x = [list(map(float, sizes.features(t))) for t in utf8(b["text"])]
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id LONG, x ARRAY<DOUBLE>")


class Model:
    def __init__(self, good: bytes, bad: bytes, calibration: Calibration | None, share: float):
        self.good, self.bad, self.calibration, self.share = good, bad, calibration, share

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out, score, predicted of every row; a narrow pass, whole texts."""
        model = self

        def run(batches):
            sizes = Sizes(model.good, model.bad)
            for b in small(batches):
                texts = utf8(b["text"])
                if model.calibration is None or not texts:
                    p = np.full(len(texts), model.share)
                else:
                    p = model.calibration(np.array([sizes.features(t) for t in texts]))
                held = [fold_of(i) == 0 for i in b["doc_id"].to_pylist()]
                yield pa.record_batch([b["doc_id"].cast(pa.int64()), pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= CUT).astype(np.int32))],
                                      ["doc_id", "held_out", "score", "predicted"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id LONG, held_out BOOLEAN, score DOUBLE, predicted INT")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Ids of the sample are chosen from the labels alone, so that no text is shuffled to find them."""
    spark = docs.sparkSession
    one = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~in_fold("doc_id", 0))
           .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
           .select("doc_id", F.col("low").cast("int").alias("label"), F.xxhash64("doc_id").alias("order")))
    share = one.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    ids = []
    for label in (1, 0):
        rows = one.where((F.col("label") == 1) == F.lit(label == 1)).orderBy("order", "doc_id").limit(sample).select("doc_id").collect()
        ids += [(r.doc_id, label, k % 2) for k, r in enumerate(rows)]
    if len({label for _, label, _ in ids}) < 2:
        return Model(b"", b"", None, 0.5 if share is None else share)
    chosen = spark.createDataFrame(ids, "doc_id LONG, label INT, half INT")
    # A sample of at most 2 * SAMPLE ids of 16 bytes: small enough to send everywhere.
    # Of rows with one id the text with the smallest hash is learned from, wherever the rows are read.
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min_by(F.struct("text", "label", "half"), F.struct(F.xxhash64("text"), "text")).alias("r")).select("doc_id", "r.*")
    head = sampled(drawn.where("half = 0")).collect()
    head = sorted(head, key=lambda r: r.doc_id)
    good, bad = (dictionary([bytes(r.pieces) for r in head if r.label == label]) for label in (1, 0))
    rows = featured(drawn.where("half = 1"), good, bad).join(F.broadcast(chosen), "doc_id").select("doc_id", "x", "label").collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    y = np.array([r.label for r in rows], float)
    if len(set(y)) < 2:
        return Model(good, bad, None, share)
    return Model(good, bad, Calibration(np.array([r.x for r in rows]), y), share)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return fit(docs, labels).score(docs)
