"""Levels, origin scans and the serving queries built on the forecast table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import _c
from ..session import stage
from .metrics import calibrate_cuts, event_metrics

# The three humidity levels (percent) and the advice text per level.
WARN, CRITICAL, CLOSE = 62.0, 67.0, 75.0
ADVICE = ("open", "limit visitors", "close")


def raw_level(v) -> Column:
    v = _c(v)
    return F.when(v >= CLOSE, 2).when(v >= CRITICAL, 1).when(v >= WARN, 1).otherwise(0)


def calibrated_level(v, cut62="cut_62", cut67="cut_67", cut75="cut_75") -> Column:
    v = _c(v)
    return F.when(v >= _c(cut75), 2).when((v >= _c(cut67)) | (v >= _c(cut62)), 1).otherwise(0)


def advice(level) -> Column:
    return F.get(F.array(*[F.lit(a) for a in ADVICE]), _c(level))


def level_cuts(df: DataFrame, keys, digits=6) -> DataFrame:
    """Calibrated cuts of the three levels, one row per key (``df`` is the calibration part)."""
    long = df.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (WARN, CRITICAL, CLOSE)])))
    cuts = calibrate_cuts(long, [*keys, "threshold"])
    return cuts.groupBy(*keys).agg(*[
        F.round(F.max(F.when(F.col("threshold") == x, F.col("cut"))), digits).alias(f"cut_{int(x)}") for x in (WARN, CRITICAL, CLOSE)])


def with_levels(df: DataFrame, cuts: DataFrame, keys) -> DataFrame:
    return (df.join(cuts, list(keys)).withColumn("level", calibrated_level("y_pred"))
            .withColumn("level_raw", raw_level("y_pred")))


def best_readout(df: DataFrame, keys, readout="model", threshold="threshold", cut="cut") -> DataFrame:
    """Readout with the best F1 pooled over horizons; the first name wins ties."""
    f1 = event_metrics(df, [*keys, readout], threshold, cut)
    best = F.min(F.struct((-F.round("f1", 9)).alias("neg"), F.col(readout))).alias("b")
    return f1.groupBy(*keys).agg(best).select(*keys, F.col(f"b.{readout}").alias(readout), (-F.col("b.neg")).alias("f1"))


def scan_origins(lev: DataFrame, keys, warn=WARN) -> DataFrame:
    """One row per origin: first alarm, first exceedance, lead, hours, peaks. One aggregation, no matrix."""
    over, alarm = F.col("y_true") >= warn, F.col("level") >= 1
    g = lev.groupBy(*keys, "origin_ts").agg(
        F.min(F.when(over, F.col("horizon_h"))).alias("first_true_h"), F.min(F.when(alarm, F.col("horizon_h"))).alias("first_alarm_h"),
        F.count_if(alarm).alias("n_alarm"), F.count_if(over).alias("n_true"),
        F.max("y_true").alias("true_peak"), F.max("y_pred").alias("pred_peak"))
    return g.where((F.col("n_alarm") > 0) & (F.col("n_true") > 0)).withColumns({
        "lead_h": F.col("first_true_h") - F.col("first_alarm_h"), "crosses": (F.col("pred_peak") >= warn).cast("int")})


def demo_candidates(scan: DataFrame, min_alarm=6, min_lead=12, min_true=6) -> DataFrame:
    """Origins that meet all three floors; if there is none at all, every true positive (``crosses`` = 0)."""
    strict = (F.col("n_alarm") >= min_alarm) & (F.col("lead_h") >= min_lead) & (F.col("n_true") >= min_true)
    s = stage(scan.withColumn("_ok", strict))
    j = s.withColumn("_n", s.agg(F.count_if("_ok")).scalar())
    return (j.where(F.col("_ok") | (F.col("_n") == 0))
            .withColumn("crosses", F.when(F.col("_n") == 0, 0).otherwise(F.col("crosses"))).drop("_ok", "_n"))


def candidate_order(tie=("series_id", "model", "origin_ts")):
    return [F.desc("crosses"), F.desc("n_true"), F.desc("lead_h"), F.desc("true_peak"), *tie]


def best_origins(candidates: DataFrame, n: int) -> DataFrame:
    """(origin_ts, rank) of the n best different origins, ranked by their best candidate."""
    key = F.struct(-F.col("crosses"), -F.col("n_true"), -F.col("lead_h"), -F.col("true_peak"), "series_id", "model", "origin_ts")
    top = candidates.groupBy("origin_ts").agg(F.min(key).alias("_key")).orderBy("_key").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("_key"))).drop("_key")


def scenario_summary(rows: DataFrame, keys) -> DataFrame:
    """Peaks, worst level, alarm hours, first alarm step (-1 if none)."""
    alarm = F.col("level") > 0
    return rows.groupBy(*keys).agg(
        F.max("y_pred").alias("pred_peak"), F.max("y_true").alias("true_peak"), F.max("level").alias("level"), F.max("level_raw").alias("level_raw"),
        F.count_if(alarm).alias("n_warn"), F.coalesce(F.min(F.when(alarm, F.col("horizon_h"))), F.lit(-1)).alias("first_warn_h"))


def forecast_arrays(rows: DataFrame, keys) -> DataFrame:
    """Serving form: step-ordered arrays per scenario (at most one row per horizon), worst level, advice, lead."""
    step = F.array_sort(F.collect_list(F.struct("horizon_h", "y_pred", "y_true", "level"))).alias("s")
    lead = F.min(F.when(F.col("level") >= 1, F.col("horizon_h"))).alias("lead_h")
    g = rows.groupBy(*keys).agg(step, F.max("level").alias("max_level"), F.max("y_pred").alias("peak"), lead)
    return g.select(*keys, F.col("s.horizon_h").alias("steps"), F.col("s.y_pred").alias("pred"), F.col("s.y_true").alias("truth"),
                    F.col("s.level").alias("levels"), "max_level", advice("max_level").alias("advice"), "peak", "lead_h")


def timeline(rows: DataFrame, keys, warn=WARN) -> DataFrame:
    """Per step flags plus the window's first alarm, first event and lead."""
    over, alarm = F.col("y_true") >= warn, F.col("level") >= 1
    first = rows.groupBy(*keys).agg(F.min(F.when(alarm, F.col("horizon_h"))).alias("first_alarm_h"),
                                    F.min(F.when(over, F.col("horizon_h"))).alias("first_event_h"))
    return rows.join(first, keys).select(*keys, "horizon_h", over.alias("over"), alarm.alias("alarm"), "first_alarm_h", "first_event_h",
                                         (F.col("first_event_h") - F.col("first_alarm_h")).alias("lead_h"))


def long_metrics(df: DataFrame, keys, metrics, table) -> DataFrame:
    """Metric table in long form, for unions of different tables."""
    return (df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
            .unpivot(list(keys), list(metrics), "metric", "value").withColumn("table", F.lit(table)))
