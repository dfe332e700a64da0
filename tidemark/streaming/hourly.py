"""Raw readings as a stream: hourly cells closed by a watermark, then scored hour by hour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.features import FeatureSpec


def hourly_cells(readings: DataFrame, key, ts, sums: dict[str, str], late="2 hours") -> DataFrame:
    """Row count and sums per (key, hour); an hour is final once the watermark passes its end."""
    r = readings.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    g = r.groupBy(F.col(key).alias("series_id"), F.window("_t", "1 hour").alias("w"))
    d = g.agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(c) for c, e in sums.items()])
    return d.select("series_id", F.col("w.start").alias("ts"), "n", *sums)


#: The state store that keeps state on disk, one map entry at a time.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(rows: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """``processor`` per series over rows (series_id, hour, ...), with event-time timers on the hours' watermark ``_t``."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy("series_id").transformWithStateInPandas(processor, schema, "append", "EventTime")


class HourScorer(StatefulProcessor):
    """Scores every hour that has a full lag window, in ascending order per series.

    State: per hour the drivers (null in a gap) and running counts and sums of the averaged drivers, so a moving mean of any
    length is two map reads; the last hour. Hours beyond the longest window are removed one by one as time goes on, and a
    timer forgets a series that has been silent for that long, which changes no later score.
    """

    def __init__(self, spec: FeatureSpec, w_raw, b_raw):
        self.spec, self.weights, self.bias = spec, np.asarray(w_raw, dtype=float), float(b_raw)
        self.depth = max([spec.lags, *spec.windows])

    def init(self, handle) -> None:
        fields = ", ".join([f"v{i} DOUBLE" for i in range(len(self.spec.drivers))] + ["n LONG"] + [f"s{i} DOUBLE" for i in range(len(self.spec.mean_of))])
        self.hours = handle.getMapState("hours", "hour LONG", fields)
        self.last = handle.getValueState("last", "hour LONG")
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues):
        spec, n_drivers = self.spec, len(self.spec.drivers)
        at = [spec.drivers.index(c) for c in spec.mean_of]
        batch = pd.concat(list(rows)).sort_values("hour")
        last = self.last.get()[0] if self.last.exists() else None
        near: dict[int, tuple] = {}  # what this batch has read or written

        def entry(h):
            if h not in near:
                near[h] = self.hours.getValue((h,)) if self.hours.containsKey((h,)) else None
            return near[h]

        def put(h, values, n, sums):
            near[h] = (*values, n, *sums)
            self.hours.updateValue((h,), near[h])

        out = []
        for h, *values in batch[["hour", *spec.drivers]].itertuples(index=False):
            h, values = int(h), [float(v) for v in values]
            if last is not None and h <= last:  # hours are final: a repeated one changes nothing
                continue
            first = last is None or h - last > self.depth
            before = (None,) * n_drivers + (0,) + (0.0,) * len(at) if first else entry(last)
            if last is not None:
                for old in range(last + 1 if not first else h, h):  # a gap repeats the sums
                    put(old, (None,) * n_drivers, before[n_drivers], before[n_drivers + 1 :])
                for old in range(last - self.depth, min(h - self.depth, last + 1)):
                    if entry(old) is not None:
                        self.hours.removeKey((old,))
                    near[old] = None
            put(h, values, before[n_drivers] + 1, [s + values[i] for s, i in zip(before[n_drivers + 1 :], at)])
            last, lags = h, [entry(h - k) for k in range(spec.lags)]
            if all(x is not None and x[0] is not None for x in lags):
                psi = [v for x in lags for v in x[:n_drivers]]
                now = near[h]
                for w in spec.windows:
                    edge = entry(h - w) or (None,) * n_drivers + (0,) + (0.0,) * len(at)
                    seen = now[n_drivers] - edge[n_drivers]
                    psi += [(a - b) / seen for a, b in zip(now[n_drivers + 1 :], edge[n_drivers + 1 :])]
                out.append((key[0], h, float(self.bias + self.weights @ np.asarray(psi))))
        if last is not None:
            self.last.update((last,))
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max((last + self.depth + 1) * 3_600_000, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["series_id", "hour", "y_pred"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.hours.clear()
        self.last.clear()
        yield from ()


def score_hours(hours: DataFrame, spec: FeatureSpec, w_raw, b_raw, late="2 hours") -> DataFrame:
    """Apply one stored readout to every hour with a full lag window; state per series has a fixed size and ends with the series."""
    src = hours.select("series_id", F.floor(F.unix_seconds("ts") / 3600).cast("long").alias("hour"), *spec.drivers, F.col("ts").cast("timestamp").alias("_t"))
    return with_state(src.withWatermark("_t", late), HourScorer(spec, w_raw, b_raw), "series_id STRING, hour LONG, y_pred DOUBLE")
