"""Alarm runs as a state machine, and the batch operator it must agree with."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.chunks import positions
from .hourly import with_state


class RunTracker(StatefulProcessor):
    """The open run of a series; a timer ends it when the series falls silent."""

    def __init__(self, cut, silence_h):
        self.cut, self.silence_h = cut, silence_h

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", "onset LONG, last LONG")
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values("hour")
        hours, on = batch["hour"].to_numpy(np.int64), batch["y_pred"].to_numpy() >= self.cut
        if self.open.exists():
            onset, last = self.open.get()
            hours, on = np.concatenate(([onset, last], hours)), np.concatenate(([True, True], on))
            joined = np.array([True])  # the run's own hours are one run, however long
        else:
            joined = np.zeros(0, bool)
        alarms = np.flatnonzero(on)
        follows = (np.diff(hours[alarms]) <= 1) & (np.diff(alarms) == 1) if len(alarms) else np.zeros(0, bool)
        follows[: len(joined)] = True
        starts = alarms[np.concatenate(([True], ~follows))] if len(alarms) else alarms
        ends = alarms[np.concatenate((~follows, [True]))] if len(alarms) else alarms
        still = len(ends) > 0 and ends[-1] == len(hours) - 1  # nothing after it yet
        done = len(ends) - still
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if still:
            onset, last = int(hours[starts[-1]]), int(hours[ends[-1]])
            self.open.update((onset, last))
            self.handle.registerTimer(max((last + self.silence_h) * 3_600_000, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.open.clear()
        if done:
            first, last = hours[starts[:done]], hours[ends[:done]]
            yield pd.DataFrame({"series_id": [key[0]] * done, "onset_hour": first, "last_hour": last, "duration_h": last - first + 1})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        onset, last = self.open.get()
        self.open.clear()
        yield pd.DataFrame({"series_id": [key[0]], "onset_hour": [onset], "last_hour": [last], "duration_h": [last - onset + 1]})


def alarm_runs_stream(scored: DataFrame, cut, silence_h=6, late="2 hours") -> DataFrame:
    """Onset, last hour and length of each run of consecutive alarm hours, emitted when it clears.

    ``scored`` has ``series_id, hour, y_pred``. A run clears at the first later hour without
    an alarm, or, if the series falls silent, once the watermark is ``silence_h`` past its last hour.
    """
    src = scored.select("series_id", "hour", "y_pred", F.timestamp_seconds(F.col("hour") * 3600).alias("_t")).withWatermark("_t", late)
    return with_state(src, RunTracker(cut, silence_h), "series_id STRING, onset_hour LONG, last_hour LONG, duration_h LONG")


def alarm_runs(scored: DataFrame, cut) -> DataFrame:
    """The same runs in batch: hours minus their rank is constant within a run."""
    on = scored.where(F.col("y_pred") >= cut).withColumn("ts", F.timestamp_seconds(F.col("hour") * 3600).cast("timestamp_ntz"))
    p = positions(on, ["series_id"]).withColumn("_run", F.col("hour") - F.col("pos"))
    return p.groupBy("series_id", "_run").agg(
        F.min("hour").alias("onset_hour"), F.max("hour").alias("last_hour"), F.count("*").alias("duration_h")).drop("_run")
