"""Streaming replay of the driver's events (X1-X3). Each stage is a finite ``availableNow`` run."""

import uuid

from pyspark.sql import functions as F

from ..operators.features import FeatureSpec
from ..session import checkpoint_dir
from ..streaming import alarms, hourly
from .q_features import lag_sql
from .registry import R, query, r6

SPEC = FeatureSpec(drivers=("t_c", "rh"), lags=3, windows=(24,), ratio=False, mean_of=("rh",))
WEIGHTS = (0.0, 0.2, 0.0, 0.1, 0.0, 0.1, 0.6)
CUT = 55.0


def drain(df, folder, name):
    """Run a stream to the end of its input into a parquet folder and return the folder."""
    out = f"{folder}/{name}"
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/_{name}")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def closed_hours(t):
    """Raw events to final hourly cells."""
    folder = f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    src = (t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
           .withColumn("k", F.get_json_object("props", "$.k").cast("long")))
    cells = hourly.hourly_cells(src, "event_type", "ts", {"v": "cast(round(value * 100) as long)", "k": "k", "u": "user_id % 100"})
    out = drain(cells, folder, "hours")
    return folder, out, t.spark.read.parquet(out).schema


def drivers(df):
    d = df.selectExpr("series_id", "ts", "n", "v div n as xc", "(k * 100) div n as kc")
    return d.select("series_id", "ts", "n", (F.expr("xc div 4 - 1000") / 100.0).alias("t_c"), (F.col("kc") / 100.0).alias("rh"))


CLOSED = "done AS (SELECT m.* FROM met m WHERE m.ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events))"


@query("x1_hourly_means", f"WITH {CLOSED} SELECT series_id, ts, n, t_c, rh FROM done")
def x1(t):
    _, out, _ = closed_hours(t)
    return drivers(t.spark.read.parquet(out)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


X2 = f"""sc AS (SELECT d.series_id, CAST(epoch(d.ts) AS BIGINT)//3600 AS hour, {R('0.2e0*d.rh + 0.1e0*a.rh + 0.1e0*b.rh + 0.6e0*d.ma')} AS y_pred FROM (SELECT *, avg(rh) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS ma FROM done) d
    JOIN done a ON a.series_id = d.series_id AND a.ts = d.ts - INTERVAL 1 HOUR JOIN done b ON b.series_id = d.series_id AND b.ts = d.ts - INTERVAL 2 HOUR)"""


def scored_hours(t):
    folder, out, schema = closed_hours(t)
    src = drivers(t.spark.readStream.schema(schema).parquet(out))
    scored = hourly.score_hours(src, SPEC, WEIGHTS, 0.0)
    return folder, drain(scored, folder, "scored")


@query("x2_score_hours", f"WITH {CLOSED}, {X2} SELECT * FROM sc")
def x2(t):
    """Scores of closed hours from the stateful replay equal the batch features times the weights."""
    return r6(t.spark.read.parquet(scored_hours(t)[1]))


@query("x3_alarm_runs", f"""WITH {CLOSED}, {X2}, r AS (SELECT series_id, hour, hour - row_number() OVER (PARTITION BY series_id ORDER BY hour) AS g FROM sc WHERE y_pred >= {CUT}),
    runs AS (SELECT series_id, min(hour) AS onset_hour, max(hour) AS last_hour, count(*) AS duration_h FROM r GROUP BY series_id, g), z AS (SELECT series_id, max(hour) AS zh FROM sc GROUP BY 1)
    SELECT series_id, onset_hour, last_hour, duration_h FROM runs JOIN z USING (series_id)
    WHERE last_hour < zh OR last_hour + 6 < (SELECT max(hour) - 2 FROM sc)""")
def x3(t):
    """Alarm runs that have cleared, by a later hour or by six hours of silence behind the watermark."""
    folder, out = scored_hours(t)
    schema = t.spark.read.parquet(out).schema
    runs = alarms.alarm_runs_stream(t.spark.readStream.schema(schema).parquet(out).withColumn("y_pred", F.round("y_pred", 6)), CUT)
    path = drain(runs, folder, "runs")
    return t.spark.read.parquet(path)
