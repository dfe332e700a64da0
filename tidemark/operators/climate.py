"""Climate statistics of series: harmonics, ranges, climatologies, lags, acceptance tables."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import HOUR, epoch_s, to_local


def harmonic_fit(df: DataFrame, keys, value, period_h, ts="ts", min_rows=None) -> DataFrame:
    """Amplitude and peak hour of one period by least squares, from grouped covariances."""
    hours = epoch_s(ts) / HOUR
    angle = F.pmod(hours, F.lit(float(period_h))) * (2 * pi / period_h)
    x = df.where(F.col(value).isNotNull()).withColumn("_c", F.cos(angle)).withColumn("_s", F.sin(angle))
    m = x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"),
        F.var_pop("_c").alias("cc"), F.var_pop("_s").alias("ss"), F.covar_pop("_c", "_s").alias("cs"),
        F.covar_pop(value, "_c").alias("yc"), F.covar_pop(value, "_s").alias("ys"))
    m = m.where(F.col("n") >= (min_rows or max(50, int(period_h))))
    det = F.nullif(F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs"), F.lit(0.0))
    a = (F.col("yc") * F.col("ss") - F.col("ys") * F.col("cs")) / det
    b = (F.col("ys") * F.col("cc") - F.col("yc") * F.col("cs")) / det
    m = m.withColumn("_a", a).withColumn("_b", b)
    return m.select(*keys, "n", "mean", F.hypot("_a", "_b").alias("amplitude"),
                    F.pmod(F.atan2("_b", "_a") * (period_h / (2 * pi)), F.lit(float(period_h))).alias("peak_h"))


def damping(fits: DataFrame, keys, zone, outer, inner, floor=0.05) -> DataFrame:
    """Amplitude ratio inner/outer and the lag in minutes where both amplitudes are significant."""
    def pick(z, c):
        return F.max(F.when(F.col(zone) == z, F.col(c)))

    p = fits.groupBy(*keys).agg(pick(outer, "amplitude").alias("amp_outer"), pick(inner, "amplitude").alias("amp_inner"),
                                pick(outer, "peak_h").alias("_po"), pick(inner, "peak_h").alias("_pi"))
    p = p.where(F.col("amp_outer").isNotNull() & F.col("amp_inner").isNotNull())
    lag = F.pmod(F.col("_pi") - F.col("_po"), F.lit(24.0)) * 60.0
    return p.select(*keys, "amp_outer", "amp_inner", F.try_divide("amp_inner", "amp_outer").alias("amp_ratio"),
                    F.when((F.col("amp_outer") > floor) & (F.col("amp_inner") > floor), lag).alias("lag_min"))


def daily_range_ratio(df: DataFrame, keys, inside, outside, tz, ts="ts", flow=None, open_days=None,
                      min_range=0.5, min_days=10) -> DataFrame:
    """Median over local days of inside range / outside range, optionally on open or closed days only."""
    day = F.to_date(to_local(ts, tz)).alias("day")
    aggs = [(F.max(inside) - F.min(inside)).alias("_i"), (F.max(outside) - F.min(outside)).alias("_o")]
    if flow:
        aggs += [((F.max(flow) + F.min(flow)) / 2).alias("_mid")]
    per = df.groupBy(*keys, day).agg(*aggs)
    if flow:
        hours = df.withColumn("day", F.to_date(to_local(ts, tz))).join(per.select(*keys, "day", "_mid"), [*keys, "day"])
        open_share = hours.groupBy(*keys, "day").agg(F.avg((F.col(flow) > F.col("_mid")).cast("double")).alias("_s"))
        per = per.join(open_share, [*keys, "day"]).where((F.col("_s") > 0.5) == F.lit(bool(open_days)))
    ok = per.where((F.col("_o") > min_range) & F.col("_i").isNotNull())
    # One value per day and key: the exact median's state is bounded by the days covered.
    return (ok.groupBy(*keys).agg(F.count("*").alias("n_days"), F.median(F.col("_i") / F.col("_o")).alias("range_ratio"))
            .where(F.col("n_days") >= min_days))


def residual_std(df: DataFrame, keys, value, ts="ts") -> DataFrame:
    """Sample deviation after removing each year-month mean, from grouped sums (no window)."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, F.year(ts), F.month(ts)).agg(
        F.count("*").alias("_n"), F.var_pop(value).alias("_v"))
    return per.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_n") * F.col("_v")) / (F.sum("_n") - 1)).alias("residual_std"))


def level_summary(df: DataFrame, keys, value, thresholds) -> DataFrame:
    """Mean, extremes, range and the share strictly above each threshold."""
    v = F.col(value)
    shares = [F.avg((v > t).cast("double")).alias(f"share_gt_{int(t)}") for t in thresholds]
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
                                 (F.max(v) - F.min(v)).alias("range"), F.stddev_samp(v).alias("std"), *shares)


def daily_peak_gain(df: DataFrame, keys, scenario, value, base, other, tz="UTC", ts="ts") -> DataFrame:
    """Mean over days of the daily peak in ``other`` minus that in ``base``."""
    day = F.to_date(to_local(ts, tz)).alias("day")
    per = df.groupBy(*keys, day).agg(F.max(F.when(F.col(scenario) == base, F.col(value))).alias("_b"),
                                     F.max(F.when(F.col(scenario) == other, F.col(value))).alias("_o"))
    return per.groupBy(*keys).agg(F.avg(F.col("_o") - F.col("_b")).alias("peak_gain"))


def weighted_error(stats: DataFrame, keys, targets: dict[str, tuple[float, float]]) -> DataFrame:
    """Sum of weight * |value - target| / |target| over columns; infinite if any is missing."""
    terms, complete = F.lit(0.0), F.lit(True)
    for c, (target, weight) in targets.items():
        terms = terms + F.abs(F.col(c) - target) * (weight / abs(target))
        complete = complete & F.col(c).isNotNull()
    return stats.select(*keys, F.when(complete, terms).otherwise(F.lit(float("inf"))).alias("score"))


def monthly_climatology(df: DataFrame, keys, value, ts="ts") -> DataFrame:
    """Range of the monthly means and the months of the extremes (earliest month on ties)."""
    per = df.groupBy(*keys, F.month(ts).alias("month")).agg(F.avg(value).alias("_m"))
    per = per.withColumn("_m", F.round("_m", 6))
    return per.groupBy(*keys).agg(
        F.min("_m").alias("lo"), F.max("_m").alias("hi"),
        F.min_by("month", F.struct(F.col("_m"), F.col("month"))).alias("month_min"),
        F.min_by("month", F.struct(-F.col("_m"), F.col("month"))).alias("month_max"))


def circular_hour(hour_col) -> Column:
    """Circular mean of hours of day, in [0, 24)."""
    w = 2 * pi / 24
    return F.pmod(F.atan2(F.avg(F.sin(hour_col * w)), F.avg(F.cos(hour_col * w))) / w, F.lit(24.0))


def hour_of_daily_extreme(df: DataFrame, keys, value, kind="max", ts="ts") -> DataFrame:
    """Hour of each day's extreme (first occurrence)."""
    v = -F.col(value) if kind == "max" else F.col(value)
    t = F.min_by(F.col(ts), F.struct(v, F.col(ts)))
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, F.to_date(ts).alias("day")).agg(t.alias("_t"))
    return per.select(*keys, "day", (F.hour("_t") + F.minute("_t") / 60.0).alias("hour"))


def wrap_minutes(lag) -> Column:
    """Lag in minutes wrapped to [-720, 720)."""
    return F.pmod(lag + 720.0, F.lit(1440.0)) - 720.0


def daily_lag(df: DataFrame, keys, inside, outside, kind="max", ts="ts") -> DataFrame:
    def mean_hour(col, out):
        return hour_of_daily_extreme(df, keys, col, kind, ts).groupBy(*keys).agg(circular_hour(F.col("hour")).alias(out))

    j = mean_hour(outside, "hour_outside").join(mean_hour(inside, "hour_inside"), keys)
    return j.withColumn("lag_min", wrap_minutes((F.col("hour_inside") - F.col("hour_outside")) * 60.0))


def acceptance(df: DataFrame, rel=0.35, floor=5.0) -> DataFrame:
    """Both interval ends within max(rel * |reference|, floor)."""
    def near(m, r):
        return F.abs(F.col(m) - F.col(r)) <= F.greatest(F.abs(F.col(r)) * rel, F.lit(floor))

    return df.withColumn("accepted", near("model_lo", "ref_lo") & near("model_hi", "ref_hi"))


def climatology(df: DataFrame, keys, value, ts="ts") -> DataFrame:
    """Mean by (month, day, hour)."""
    t = F.col(ts)
    return df.groupBy(*keys, F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour")).agg(
        F.avg(value).alias("clim"))


def linear_relation(df: DataFrame, keys, y, x) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))
