"""Moment matrices of feature vectors, built where the rows are and summed by the shuffle.

Each task turns its Arrow batches into partial moment rows; Spark adds them up per
(key, horizon, row index) with map-side combining. Nothing of the size of the data, and no
per-partition matrix, reaches the driver; solving happens in one small group per key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

SHARED = -1  # horizon index of the part that all horizons share
MAX_BYTES = 256 << 20  # partial matrices held by a task before they are emitted
MODEL_BYTES = 64 << 20  # model tables that every task may hold


def matrix(col) -> np.ndarray:
    """Arrow list column to an (n, p) float matrix; nulls become NaN."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten()
    out = flat.to_numpy(zero_copy_only=False).astype(float, copy=False)
    return out.reshape(len(col), -1)


def key_slices(batch, keys):
    """(key tuple, row indices) for the key values present in a batch."""
    if batch.num_rows == 0:
        return
    frame = batch.select(keys).to_pandas()
    for key, idx in frame.groupby(keys, sort=False, dropna=False).indices.items():
        yield (key if isinstance(key, tuple) else (key,)), idx


def vector_stats(df: DataFrame, keys, psi="psi", floor=1e-12) -> DataFrame:
    """Population mean and deviation of each vector entry per key (JVM side, mergeable)."""
    s = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(psi)))
    d = df.groupBy(*keys).agg(s.alias("s"))
    n = F.col("s.count").cast("double")
    pop = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1.0) / n))
    return d.select(*keys, F.col("s.count").alias("n_rows"), vector_to_array("s.mean").alias("mu"),
                    F.transform(pop, lambda v: F.when(v < floor, 1.0).otherwise(v)).alias("sigma"))


def standardise_vectors(df: DataFrame, stats: DataFrame, keys, psi="psi", out="z") -> DataFrame:
    j = df.join(stats.select(*keys, "mu", "sigma"), list(keys))
    centred = F.zip_with(psi, "mu", lambda x, m: x - m)
    return j.withColumn(out, F.zip_with(centred, "sigma", lambda x, s: x / s)).drop("mu", "sigma")


def moment_schema(df, keys, extra=("h INT", "i INT", "g ARRAY<DOUBLE>")):
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([f"{k} {types[k]}" for k in keys] + list(extra))


def emit_moments(keys, acc):
    """Accumulated {(key, h): matrix} to record batches of (keys, h, i, g)."""
    for (key, h), m in acc.items():
        n = len(m)
        cols = {k: pa.array([v] * n) for k, v in zip(keys, key)}
        cols["h"] = pa.array([h] * n, pa.int32())
        cols["i"] = pa.array(range(n), pa.int32())
        cols["g"] = pa.array(list(m), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_pydict(cols)


def summed_moments(parts: DataFrame, keys) -> DataFrame:
    total = parts.groupBy(*keys, "h", "i").agg(Summarizer.sum(array_to_vector("g")).alias("g"))
    return total.withColumn("g", vector_to_array("g"))


def held_bytes(acc):
    return sum(m.nbytes for m in acc.values())


def grams(df: DataFrame, keys, z="z", labels="labels", gaps=range, max_bytes=MAX_BYTES) -> DataFrame:
    """Moment rows ``(keys, h, i, g)`` of the vectors ``[z, 1]`` and each label horizon.

    ``h = -1`` holds the matrix over all rows; for each horizon, row 0 holds
    ``[A'y, y'y]`` over its labelled rows and further rows (if any) the matrix of the rows
    without that label, to be subtracted. So any number of horizons costs one pass.
    ``gaps(n)`` names for each label the label whose missing rows are also its own; labels that are missing
    together share one such matrix. A task emits what it holds whenever that exceeds ``max_bytes``.
    """
    def run(batches):
        acc = {}
        for b in batches:
            Z, Y = matrix(b.column(z)), matrix(b.column(labels))
            A = np.column_stack([Z, np.ones(len(Z))])
            for key, idx in key_slices(b, keys):
                add_moments(acc, key, A[idx], Y[idx], gaps)
                if held_bytes(acc) > max_bytes:
                    yield from emit_moments(keys, acc)
                    acc = {}
        yield from emit_moments(keys, acc)

    need = df.select(*keys, z, labels)
    parts = need.mapInArrow(run, moment_schema(df, keys))
    return summed_moments(parts, keys)


def add_moments(acc, key, a, y, gaps=range):
    """Adds rows ``a`` (with the constant) and their labels to the matrices of a key."""
    _add(acc, (key, SHARED), a.T @ a)
    ok = np.isfinite(y)
    y0 = np.where(ok, y, 0.0)
    cross = np.column_stack([y0.T @ a, (y0 * y0).sum(axis=0)])
    for h in range(y.shape[1]):
        _add(acc, (key, 2 * h), cross[h : h + 1])
    for h in set(gaps(y.shape[1])):
        gone = a[~ok[:, h]]
        if len(gone):
            _add(acc, (key, 2 * h + 1), gone.T @ gone)


def _add(acc, k, m):
    acc[k] = acc[k] + m if k in acc else m


def unpack(pdf, n_labels, gaps=range):
    """Moment rows of one key to ``[(G, b, yy)]`` per horizon (sums, not means); ``gaps`` as given to ``grams``."""
    by_h = {h: np.vstack(g.sort_values("i")["g"].to_list()) for h, g in pdf.groupby("h")}
    G = by_h[SHARED]
    out = []
    for h, gap in zip(range(n_labels), gaps(n_labels)):
        row = by_h[2 * h][0]
        out.append((G - by_h.get(2 * gap + 1, 0.0), row[:-1], float(row[-1])))
    return out


def weighted_grams(df: DataFrame, keys, weigh, n_sets, z="z", labels="labels") -> DataFrame:
    """One full moment matrix ``[A, y]'W[A, y]`` per weight set.

    ``weigh(A, Y)`` returns for each set ``(label index, weights)``; used by the reweighted fits.
    """
    def run(batches):
        acc = {}
        for b in batches:
            Z, Y = matrix(b.column(z)), matrix(b.column(labels))
            A = np.column_stack([Z, np.ones(len(Z))])
            for key, idx in key_slices(b, keys):
                for s, (h, w) in enumerate(weigh(A[idx], Y[idx])):
                    y = Y[idx][:, h]
                    ok = np.isfinite(y)
                    full = np.column_stack([A[idx][ok], y[ok]])
                    _add(acc, (key, s), (full * w[ok][:, None]).T @ full)
                if held_bytes(acc) > MAX_BYTES:
                    yield from emit_moments(keys, acc)
                    acc = {}
        yield from emit_moments(keys, acc)

    parts = df.select(*keys, z, labels).mapInArrow(run, moment_schema(df, keys))
    return summed_moments(parts, keys)


def triangular(df: DataFrame, keys, z="z", y="y", weight=None, fan_in=32) -> DataFrame:
    """R factor of ``sqrt(w) * [z, 1, y]`` per key by a tree of QR steps.

    Tasks factor their own rows; factors are stacked ``fan_in`` at a time on the way up, so
    no step holds more than ``fan_in`` factors whatever the number of tasks.
    """
    def local(batches):
        acc, pid = {}, TaskContext.get().partitionId()
        for b in batches:
            Z = matrix(b.column(z))
            rows = np.column_stack([Z, np.ones(len(Z)), b.column(y).to_numpy(zero_copy_only=False)])
            if weight:
                rows = rows * np.sqrt(b.column(weight).to_numpy(zero_copy_only=False))[:, None]
            for key, idx in key_slices(b, keys):
                part = rows[idx][np.isfinite(rows[idx]).all(axis=1)]
                acc[key, pid] = np.linalg.qr(np.vstack([acc[key, pid], part]) if (key, pid) in acc else part, mode="r")
                if held_bytes(acc) > MAX_BYTES:
                    yield from emit_moments(keys, acc)
                    acc = {}
        yield from emit_moments(keys, acc)

    cols = [z, y] + ([weight] if weight else [])
    schema = moment_schema(df, keys)
    level = df.select(*keys, *cols).mapInArrow(local, schema)

    def stack(pdf):
        import pandas as pd

        r = np.linalg.qr(np.vstack(pdf.sort_values(["h", "i"])["g"].to_list()), mode="r")
        head = {k: pdf[k].iloc[0] for k in keys} | {"h": int(pdf["up"].iloc[0])}
        return pd.DataFrame([{**head, "i": i, "g": row} for i, row in enumerate(r)])

    for _ in range(3):  # 32^3 tasks below the last step
        level = level.withColumn("up", (F.col("h") / fan_in).cast("int")).groupBy(*keys, "up").applyInPandas(stack, schema)
    return level.withColumn("up", F.lit(0)).groupBy(*keys, "up").applyInPandas(stack, schema)
