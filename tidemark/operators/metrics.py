"""Forecast scores per key: accuracy, events, AUC, cuts, duration, lead time, probabilistic scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import HOUR, epoch_s
from .chunks import windowed
from .order import quantiles, running_totals, sent


def regression_metrics(df: DataFrame, keys, y="y_true", p="y_pred", min_pairs=1) -> DataFrame:
    """RMSE, MAE, R2 = 1 - SSE/SST, bias and nRMSE; null where undefined or below ``min_pairs``."""
    e = F.col(p) - F.col(y)
    ok = F.col(y).isNotNull() & F.col(p).isNotNull()
    m = df.where(ok).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"), F.avg(e * e).alias("_mse"), F.var_pop(y).alias("_var"))
    enough = F.col("n") >= min_pairs
    return m.select(
        *keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in ("rmse", "mae", "bias")],
        F.when(enough, 1 - F.col("_mse") / F.nullif("_var", F.lit(0.0))).alias("r2"),
        F.when(enough, F.col("rmse") / F.nullif(F.sqrt("_var"), F.lit(0.0))).alias("nrmse"))


def event_metrics(df: DataFrame, keys, threshold="threshold", cut="cut", y="y_true", p="y_pred") -> DataFrame:
    a = F.col(y) >= F.col(threshold)
    b = F.col(p) >= F.col(cut)
    c = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(
        F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"),
        F.count_if(a).alias("n_event"), F.count("*").alias("n"), F.count_if(b).alias("n_alarm"))
    zero = F.lit(0.0)
    c = (c.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero))
         .withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero)))
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select(*keys, "n", "n_event", "tp", "fp", "fn", (F.col("n_event") / F.col("n")).alias("base_rate"),
                    (F.col("n_alarm") / F.col("n")).alias("alarm_rate"), "precision", "recall",
                    F.coalesce(f1, zero).alias("f1"))


def exact_auc(df: DataFrame, keys, positive, score="y_pred") -> DataFrame:
    """ROC AUC with ties sharing rank; null when a key has one class only."""
    pos = F.when(positive, 1).otherwise(0)
    per = df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.sum(pos).alias("_p"), (F.count("*") - F.sum(pos)).alias("_q"))
    run = running_totals(per, keys, ["_s"], {"_below": "_q"})
    s = run.groupBy(*keys).agg(
        F.sum(F.col("_p").cast("double") * (F.col("_below") + F.col("_q") / 2.0)).alias("_u"),
        F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    area = F.try_divide("_u", F.col("n_pos").cast("double") * F.col("n_neg"))
    return s.select(*keys, "n_pos", "n_neg", area.alias("auc"))


def calibrate_cuts(df: DataFrame, keys, threshold="threshold", y="y_true", p="y_pred") -> DataFrame:
    """Cut = quantile of predictions at 1 - base rate; the threshold itself when there was no event.

    ``keys`` must contain the threshold column. Predictions are ordered once per key.
    """
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    rate = ok.groupBy(*keys).agg(F.avg((F.col(y) >= F.col(threshold)).cast("double")).alias("base_rate"))
    q = quantiles(ok, keys, p, rate.select(*keys, (1 - F.col("base_rate")).alias("q")))
    return rate.join(q, keys).select(
        *keys, "base_rate", F.when(F.col("base_rate") > 0, F.col("quantile")).otherwise(F.col(threshold)).alias("cut"))


def block_hours(df: DataFrame, keys, threshold="threshold", cut="cut", y="y_true", p="y_pred", ts="valid_ts", hours=24) -> DataFrame:
    """Event and alarm hours per time block; a last block that is not over yet is dropped."""
    e = epoch_s(ts)
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    blocks = ok.groupBy(*keys, F.floor(e / (hours * HOUR)).cast("long").alias("block")).agg(
        F.count_if(F.col(y) >= F.col(threshold)).alias("a"), F.count_if(F.col(p) >= F.col(cut)).alias("b"),
        F.max(e).alias("_last"))
    last = F.max("_last").over(Window.partitionBy(*keys))
    return (blocks.withColumn("_end", last)
            .where((F.col("block") + 1) * hours * HOUR <= F.col("_end") + HOUR).drop("_last", "_end"))


def duration_metrics(blocks: DataFrame, keys) -> DataFrame:
    """Event-conditional duration scores from ``block_hours``."""
    a, b = F.col("a"), F.col("b")
    event, alarm = a > 0, b > 0
    hit, miss, false = event & alarm, event & ~alarm, ~event & alarm
    cost = F.when(hit, F.abs(b - a)).when(miss, a).when(false, b)
    return blocks.groupBy(*keys).agg(
        F.count("*").alias("n_window"), F.count_if(event).alias("n_event_window"),
        F.try_divide(F.count_if(hit), F.count_if(event)).alias("hit_window"),
        F.avg(F.when(hit, F.abs(b - a))).alias("cond_dur_mae_h"),
        F.avg(cost).alias("joint_dur_mae_h"),
        F.coalesce(F.avg(F.when(false, b)), F.lit(0.0)).alias("false_alarm_h"),
        F.avg(F.when(event, b - a)).alias("dur_bias_h"))


def plain_duration_error(blocks: DataFrame, keys) -> DataFrame:
    """Unconditional block error. Degenerate for rare events: kept for comparison only."""
    d = (F.col("b") - F.col("a")).cast("double")
    return blocks.groupBy(*keys).agg(F.avg(F.abs(d)).alias("dur_mae_h"), F.avg(d).alias("dur_bias_h"),
                                     F.sqrt(F.avg(d * d)).alias("dur_rmse_h"))


def event_block_metrics(blocks: DataFrame, keys) -> DataFrame:
    """Second duration variant: error over all event blocks, false rate over quiet blocks."""
    a, b = F.col("a"), F.col("b")
    zero = F.lit(0.0)
    return blocks.groupBy(*keys).agg(
        F.count_if(a > 0).alias("n_event_block"),
        F.coalesce(F.avg(F.when(a > 0, (b > 0).cast("double"))), zero).alias("hit_window"),
        F.coalesce(F.avg(F.when(a == 0, (b > 0).cast("double"))), zero).alias("false_window"),
        F.avg(F.when(a > 0, F.abs(b - a))).alias("cond_dur_mae_h"))


def onset_leads(df: DataFrame, keys, threshold="threshold", cut="cut", y="y_true", p="y_pred", ts="valid_ts", hours=72) -> DataFrame:
    """One row per onset with the hours since the earliest alarm valid in the ``hours`` before it.

    An onset is an exceeding hour whose previous hour did not exceed (or was not observed).
    Onsets in a key's first ``hours`` have no full look-back: their lead is null.
    """
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        *keys, ts, (F.col(y) >= F.col(threshold)).alias("_a"), (F.col(p) >= F.col(cut)).alias("_b"))
    e = epoch_s(ts)
    start = ok.groupBy(*keys).agg(F.min(e).alias("_start"))

    def make(f):
        return {"_prev": f.at("_a", -1), "_first": F.min(F.when(F.col("_b"), F.col("_e"))).over(f.between(-hours, -1))}

    rows = windowed(ok, keys, make, ts, back=hours).where(F.col("_a") & ~F.coalesce("_prev", F.lit(False)))
    late = (e - F.col("_start")) >= hours * HOUR
    return rows.join(start, keys).select(*keys, ts, F.when(late, (e - F.col("_first")) / HOUR).alias("lead_h"))


def lead_time(df: DataFrame, keys, **names) -> DataFrame:
    """Onsets, warned onsets, detection rate and mean lead per key (zero onsets included)."""
    per = onset_leads(df, keys, **names).groupBy(*keys).agg(
        F.count("*").alias("n_onset"), F.count("lead_h").alias("n_warned"), F.avg("lead_h").alias("mean_lead_h"))
    out = df.select(*keys).distinct().join(per, keys, "left")
    return out.select(
        *keys, F.coalesce("n_onset", F.lit(0)).cast("long").alias("n_onset"),
        F.coalesce("n_warned", F.lit(0)).cast("long").alias("n_warned"),
        (F.col("n_warned") / F.col("n_onset")).alias("detect_rate"), "mean_lead_h")


def issue_time_lead(df: DataFrame, keys, horizon="horizon_h", threshold="threshold", cut="cut", y="y_true", p="y_pred", ts="valid_ts") -> DataFrame:
    """Onsets of a key and how long before them the first forecast was issued that alarms at the onset itself.

    ``keys`` name a model without its horizon. Unlike ``lead_time``, which counts any alarm valid in the hours before, a
    forecast of horizon h can be h hours early at most.
    """
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    hours = ok.groupBy(*keys, ts).agg(F.max((F.col(y) >= F.col(threshold))).alias("_a"), F.max(F.when(F.col(p) >= F.col(cut), F.col(horizon))).alias("_lead"))
    on = windowed(hours, keys, lambda f: {"_prev": f.at("_a", -1)}, ts, back=1).where(F.col("_a") & ~F.coalesce("_prev", F.lit(False)))
    return on.groupBy(*keys).agg(F.count("*").alias("n_onset"), F.count("_lead").alias("n_warned"), F.avg("_lead").alias("mean_issue_lead_h"))


def peak_capture(df: DataFrame, keys, q=0.99, y="y_true", p="y_pred") -> DataFrame:
    """Mean prediction over mean truth where the truth is in its top share."""
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    targets = ok.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, F.lit(float(q)).alias("q"))
    top = ok.join(sent(quantiles(ok, keys, y, targets)), keys).where(F.col(y) >= F.col("quantile"))
    return top.groupBy(*keys).agg(
        F.count("*").alias("peak_n"), F.avg(y).alias("peak_true"), F.avg(p).alias("peak_pred"),
        F.try_divide(F.avg(p), F.avg(y)).alias("peak_ratio"))


def agreement(df: DataFrame, keys, a="a", b="b", min_pairs=10) -> DataFrame:
    """Two-source agreement: n, Pearson r, bias, RMSE, MAE."""
    d = F.col(b) - F.col(a)
    m = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.corr(a, b).alias("r"), F.avg(d).alias("bias"),
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))
    return m.where(F.col("n") >= min_pairs)


def degeneracy(df: DataFrame, keys, p="y_pred", lo=0.0, hi=100.0) -> DataFrame:
    """Is a forecast stuck? Range, spread, distinct values, share at the clip bounds."""
    distinct = (df.where(F.col(p).isNotNull()).groupBy(*keys, F.round(p, 6).alias("_v")).agg(F.count("*").alias("_n"))
                .groupBy(*keys).agg(F.count("*").alias("n_distinct")))
    stats = df.groupBy(*keys).agg(
        F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"),
        F.avg((F.col(p) <= lo).cast("double")).alias("share_lo"), F.avg((F.col(p) >= hi).cast("double")).alias("share_hi"))
    return stats.join(distinct, keys)


def deltas_to(df: DataFrame, keys, label, reference, values) -> DataFrame:
    """Each row's metrics minus those of the row labelled ``reference``."""
    ref = df.where(F.col(label) == reference).select(*keys, *[F.col(v).alias(f"_r_{v}") for v in values])
    return df.join(ref, keys).select(*keys, label, *values, *[(F.col(v) - F.col(f"_r_{v}")).alias(f"d_{v}") for v in values])
