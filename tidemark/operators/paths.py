"""Forecast paths as arrays: one row per origin from features to alarms, never one row per step.

``score_features`` gives every origin the predictions of all readouts (readout by readout, step by step) and the truth path.
Cuts are exact quantiles per place of these arrays, found by radix selection: every pass counts, per place and wanted rank, the
next byte of the values that share the bytes found so far, so eight passes of small sums replace a sort of a long table.
Levels and scans are then array functions of a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .alarms import CLOSE, CRITICAL, WARN
from .moments import matrix

THRESHOLDS = (WARN, CRITICAL, CLOSE)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order (both zeros are one value)."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def _value(u: np.ndarray) -> np.ndarray:
    return np.where(u >> np.uint64(63), u & np.uint64((1 << 63) - 1), ~u).view(np.float64)


def _sums(rows: DataFrame, count, width: int, columns) -> np.ndarray:
    """Sum of ``count(batch)`` over all batches: a vector per task, added up by Spark."""
    def run(batches):
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += count(*[matrix(b.column(c)) for c in columns])
        yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.float64()))})

    got = rows.select(*columns).mapInArrow(run, "v ARRAY<DOUBLE>").agg(vector_to_array(Summarizer.sum(array_to_vector("v")))).first()[0]
    return np.zeros(width) if got is None else np.array(got)


def array_ranks(rows: DataFrame, ranks: np.ndarray, preds="preds", labels="labels") -> np.ndarray:
    """The values at ``ranks`` (place, wanted; from 0) among the valid values of every place; NaN ranks give NaN.

    A place is valid where its prediction and its truth (labels repeat over the readouts) are there.
    """
    places, wanted = ranks.shape
    found = np.zeros((places, wanted), np.uint64)
    left = np.where(np.isfinite(ranks), ranks, 0).astype(np.int64)
    for byte in range(8):
        shift = np.uint64(56 - 8 * byte)
        known = found.copy()

        def count(P, Y):
            ok = np.isfinite(P) & np.isfinite(np.tile(Y, (1, P.shape[1] // Y.shape[1])))
            U = _ordered(P)
            out = np.zeros((places, wanted, 256))
            for k in range(wanted):
                same = ok & ((U >> shift >> np.uint64(8) == known[:, k]) if byte else True)
                at = np.broadcast_to(np.arange(places), P.shape)[same] * 256 + ((U[same] >> shift) & np.uint64(255)).astype(np.int64)
                out[:, k] += np.bincount(at, minlength=places * 256).reshape(places, 256)
            return out.ravel()

        counts = _sums(rows, count, places * wanted * 256, (preds, labels)).reshape(places, wanted, 256)
        below = np.cumsum(counts, axis=2)
        digit = np.minimum((below <= left[:, :, None]).sum(axis=2), 255)
        before = np.where(digit > 0, np.take_along_axis(below, np.maximum(digit - 1, 0)[:, :, None], axis=2)[:, :, 0], 0)
        left = left - before.astype(np.int64)
        found = (found << np.uint64(8)) | digit.astype(np.uint64)
    return np.where(np.isfinite(ranks), _value(found), np.nan)


def path_cuts(rows: DataFrame, thresholds=THRESHOLDS, preds="preds", labels="labels", digits=6) -> np.ndarray:
    """(threshold, place): cut on the prediction that alarms as often as the truth exceeds; the threshold itself without an event."""
    rows = stage(rows.select(preds, labels))
    size = rows.select(F.size(preds).alias("p"), F.size(labels).alias("l")).first()
    if size is None:
        return np.zeros((len(thresholds), 0))
    places, steps = size["p"], size["l"]

    def rates(P, Y):
        Y = np.tile(Y, (1, places // steps))
        ok = np.isfinite(P) & np.isfinite(Y)
        return np.concatenate([ok.sum(axis=0), *[(ok & (Y >= t)).sum(axis=0) for t in thresholds]]).astype(float)

    n, *events = _sums(rows, rates, places * (1 + len(thresholds)), (preds, labels)).reshape(1 + len(thresholds), places)
    with np.errstate(all="ignore"):
        at = np.stack([(1 - e / n) * (n - 1) for e in events])
    at = np.where(np.stack(events) > 0, at, np.nan)
    lo, hi = np.floor(at), np.ceil(at)
    values = array_ranks(rows, np.concatenate([lo, hi]).T, preds, labels).T
    a, z = values[: len(thresholds)], values[len(thresholds) :]
    cut = a + (z - a) * (at - lo)
    return np.where(np.isfinite(cut), np.round(cut, digits), np.array(thresholds)[:, None])


def level_paths(rows: DataFrame, cuts: np.ndarray, readouts, steps, preds="preds") -> DataFrame:
    """``levels``: a struct with one array of 0, 1, 2 per readout; ``paths``: its predictions."""
    n = len(steps)

    def lit(row, k):
        return F.array(*[F.lit(float(v)) for v in cuts[row, k * n : (k + 1) * n]])

    def level(k):
        low, mid, high = (lit(i, k) for i in range(3))
        path = F.transform(F.slice(preds, k * n + 1, n), lambda v: F.when(~F.isnan(v), v))
        return path, F.transform(F.arrays_zip(path.alias("p"), low.alias("a"), mid.alias("b"), high.alias("c")), lambda x: F.when(x["p"].isNull(), None).when(
            x["p"] >= x["c"], 2).when((x["p"] >= x["b"]) | (x["p"] >= x["a"]), 1).otherwise(0))

    made = [level(k) for k in range(len(readouts))]
    return rows.withColumns({"paths": F.struct(*[p.alias(r) for (p, _), r in zip(made, readouts)]), "levels": F.struct(*[v.alias(r) for (_, v), r in zip(made, readouts)])})


def scan_paths(rows: DataFrame, keys, readouts, steps, labels="labels", warn=WARN) -> DataFrame:
    """One row per (origin, readout) with an alarm and an exceedance: first hours, lead, hours, peaks; arrays only."""
    hours = F.array(*[F.lit(int(s)) for s in steps])
    truth = F.transform(labels, lambda v: F.when(~F.isnan(v), v))
    one = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(r).alias("model"), F.col(f"paths.{r}").alias("p"), F.col(f"levels.{r}").alias("l"), truth.alias("y"), hours.alias("h"))
                                               for r in readouts])).alias("x"))
    both = F.filter(F.arrays_zip("x.p", "x.l", "x.y", "x.h"), lambda z: z["p"].isNotNull() & z["y"].isNotNull())
    one = one.select(*keys, "x.model", both.alias("z"))
    alarm, over = F.filter("z", lambda z: z["l"] >= 1), F.filter("z", lambda z: z["y"] >= warn)
    first = lambda a: F.array_min(F.transform(a, lambda z: z["h"]))
    out = one.select(*keys, "model", first(over).alias("first_true_h"), first(alarm).alias("first_alarm_h"), F.size(alarm).cast("long").alias("n_alarm"), F.size(over).cast("long").alias("n_true"),
                     F.array_max(F.transform("z", lambda z: z["y"])).alias("true_peak"), F.array_max(F.transform("z", lambda z: z["p"])).alias("pred_peak"))
    return out.where("n_alarm > 0 AND n_true > 0").withColumns({
        "lead_h": F.col("first_true_h") - F.col("first_alarm_h"), "crosses": (F.col("pred_peak") >= warn).cast("int")})


def readout_names(models: DataFrame, readouts) -> list[tuple]:
    """The readouts in the order of ``preds``."""
    return [tuple(r) for r in models.select(*readouts).distinct().orderBy(*readouts).collect()]
