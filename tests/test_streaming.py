import numpy as np
from pyspark.sql import functions as F

from helpers import frame
from tidemark.plans import QUERIES
from tidemark.plans.q_streaming import CUT, drain
from tidemark.operators.features import FeatureSpec, build_features
from tidemark.streaming import alarms, hourly

SMALL = "/root/testdata/sf0.001"


def runs(rows):
    return sorted((r["series_id"], r["onset_hour"], r["last_hour"], r["duration_h"]) for r in rows)


def test_x3_batch_runs(spark):
    d = frame(spark, "series_id STRING, hour LONG, y_pred DOUBLE", [("a", h, v) for h, v in ((1, 9.0), (2, 9.0), (3, 1.0), (4, 9.0), (6, 9.0))])
    assert runs(alarms.alarm_runs(d, 5.0).collect()) == [("a", 1, 2, 2), ("a", 4, 4, 1), ("a", 6, 6, 1)]


def test_x3_stream_equals_batch_over_several_batches(spark, tmp_path):
    """Files arrive one at a time: state crosses batches, and silence clears an open run."""
    src = str(tmp_path / "in")
    a = [("a", 1000 + h, 9.0 if h % 7 < 3 else 1.0) for h in range(60)]
    b = [("b", 1000 + h, 9.0) for h in range(5)]
    for part in ([r for r in a if r[1] < 1016] + b, [r for r in a if 1016 <= r[1] < 1030], [r for r in a if r[1] >= 1030]):
        frame(spark, "series_id STRING, hour LONG, y_pred DOUBLE", part).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("series_id STRING, hour LONG, y_pred DOUBLE").option("maxFilesPerTrigger", 1).parquet(src)
    got = runs(spark.read.parquet(drain(alarms.alarm_runs_stream(s, 5.0), str(tmp_path), "runs")).collect())
    every = runs(alarms.alarm_runs(spark.read.parquet(src), 5.0).collect())
    assert got == [r for r in every if r[0] == "b" or r[2] < 1059]


def hours_frame(spark, rows):
    return spark.createDataFrame(rows, "series_id STRING, hour LONG, t_c DOUBLE, rh DOUBLE").select(
        "series_id", F.timestamp_seconds(F.col("hour") * 3600).alias("ts"), "t_c", "rh")


def test_x2_state_matches_batch_over_several_batches(spark, tmp_path):
    """A 30-day window, gaps, a late starter; files arrive one at a time. The stream equals features times weights in batch."""
    rng = np.random.default_rng(1)
    spec = FeatureSpec(drivers=("t_c", "rh"), lags=3, windows=(24, 720), ratio=False, mean_of=("rh", "t_c"))
    rows = [(s, 400_000 + h, float(rng.normal()), float(rng.normal())) for s, first in (("a", 0), ("b", 500)) for h in range(first, 1100) if rng.random() > 0.1 and not 600 < h < 640]
    src, weights = str(tmp_path / "in"), rng.normal(size=10)
    for lo, hi in ((0, 300), (300, 301), (301, 800), (800, 1100)):
        hours_frame(spark, [r for r in rows if lo <= r[1] - 400_000 < hi]).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("series_id STRING, ts TIMESTAMP, t_c DOUBLE, rh DOUBLE").option("maxFilesPerTrigger", 1).parquet(src)
    out = spark.read.parquet(drain(hourly.score_hours(s, spec, weights, 0.5), str(tmp_path), "scored"))
    got = {(r.series_id, r.hour): r.y_pred for r in out.collect()}
    f = build_features(hours_frame(spark, rows).withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["series_id"], spec)
    want = {(r.series_id, int(r.e // 3600)): 0.5 + float(np.dot(r.psi, weights)) for r in f.withColumn("e", F.unix_seconds(F.col("ts").cast("timestamp"))).collect()}
    assert got.keys() == want.keys() and len(got) > 800
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_x2_forgets_silent_series(spark, tmp_path):
    """The state of a series that has been silent for longer than its windows is gone, and hours behind the window too."""
    spec = FeatureSpec(drivers=("t_c", "rh"), lags=2, windows=(6,), ratio=False, mean_of=("rh",))
    src = str(tmp_path / "in")
    for rows in ([("quiet", 1000 + h, 1.0, 2.0) for h in range(8)] + [("on", 1000 + h, 1.0, 2.0) for h in range(8)], [("on", 1008 + h, 1.0, 2.0) for h in range(40)], [("on", 1048, 1.0, 2.0)]):
        hours_frame(spark, rows).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("series_id STRING, ts TIMESTAMP, t_c DOUBLE, rh DOUBLE").option("maxFilesPerTrigger", 1).parquet(src)
    drain(hourly.score_hours(s, spec, [0.0] * 5, 0.0), str(tmp_path), "scored")
    state = spark.read.format("statestore").option("path", str(tmp_path / "_scored")).option("stateVarName", "hours").load()
    left = sorted((r.key.series_id, r.user_map_key.hour) for r in state.collect())
    assert {s for s, _ in left} == {"on"} and [h for _, h in left] == list(range(1043 - 1, 1049))[-len(left):] and len(left) <= 7


def test_x2_scores_the_events(spark):
    assert QUERIES["x2_score_hours"](spark, SMALL).count() > 0
