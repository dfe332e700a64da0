"""Key joins, the nearest as-of join, and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import epoch_us


def asof_nearest(left, right, keys, left_ts, right_ts, tolerance_s, splits=64) -> DataFrame:
    """Nearest right row within a tolerance (inclusive); a tie goes to the earlier one.

    ``right`` is unique on (keys, right_ts). Time is cut into buckets of tolerance/splits.
    Inside a bucket the neighbours come from one ordered pass over both sides; across
    buckets only each bucket's first and last right time is carried. No pair of rows is
    ever formed, and copies of one left time are matched once.
    """
    tol = int(tolerance_s * 1_000_000)
    sub = max(tol // splits, 1)
    reach = tol // sub + 1
    bucket = F.floor(F.col("_us") / F.lit(sub)).cast("long")
    lt = left.select(*keys, epoch_us(left_ts).alias("_us")).distinct().withColumn("_b", bucket)
    rt = right.select(*keys, epoch_us(right_ts).alias("_us")).distinct().withColumn("_b", bucket)

    # Bucket summaries: first and last right time, plus the buckets that hold left rows.
    per = (rt.select(*keys, "_b", F.col("_us").alias("_r"))
           .unionByName(lt.select(*keys, "_b", F.lit(None).cast("long").alias("_r")))
           .groupBy(*keys, "_b").agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi")))
    span = reach * 64
    cut = per.withColumn("_home", F.floor(F.col("_b") / span)).withColumn("_k", F.explode(F.sequence(
        F.floor((F.col("_b") - reach) / span), F.floor((F.col("_b") + reach) / span))))
    fwd = Window.partitionBy(*keys, "_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bwd = Window.partitionBy(*keys, "_k").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = (cut.withColumn("_before", F.last("_hi", True).over(fwd)).withColumn("_after", F.last("_lo", True).over(bwd))
             .where("_k = _home").select(*keys, "_b", "_before", "_after"))

    both = (lt.withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None).cast("long"))
            .unionByName(rt.withColumn("_side", F.lit(0)).withColumn("_r", F.col("_us"))))
    up = Window.partitionBy(*keys, "_b").orderBy("_us", "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_b").orderBy(F.col("_us").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = (both.withColumn("_p", F.last("_r", True).over(up)).withColumn("_n", F.last("_r", True).over(down))
              .where("_side = 1"))
    near = inside.join(carry, [*keys, "_b"])
    prev = F.coalesce("_p", "_before")
    nxt = F.coalesce("_n", "_after")
    dp, dn = F.col("_us") - prev, nxt - F.col("_us")
    pick = F.when(dn.isNull() | (dp <= dn), prev).otherwise(nxt)
    found = near.select(*keys, "_us", pick.alias("_match")).where(F.abs(F.col("_match") - F.col("_us")) <= tol)

    rcols = [c for c in right.columns if c not in keys]
    out = left.withColumn("_us", epoch_us(left_ts)).join(found, [*keys, "_us"], "left")
    tagged = right.withColumn("_match", epoch_us(right_ts))
    return out.join(tagged, [*keys, "_match"], "left").select(*left.columns, *rcols)


def calendar_lookup(df, table, parts: dict, keys=()) -> DataFrame:
    """Left join on calendar parts of the row's own (valid) time; a missing key gives null."""
    return df.withColumns(parts).join(table, [*keys, *parts], "left")


def attach_cuts(df, cuts, on=("threshold", "model", "horizon_h")) -> DataFrame:
    return df.join(cuts, list(on), "left")


def zone_pairs(df, keys, zone, value, first, second) -> DataFrame:
    """Two zones of one unit side by side on the same time."""
    def side(name, out):
        return df.where(F.col(zone) == name).select(*keys, F.col(value).alias(out))

    return side(first, f"{value}_{first}").join(side(second, f"{value}_{second}"), list(keys))


def by_label(df, keys, label, labels, value) -> DataFrame:
    """Pivot of a few known labels by conditional aggregation."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(label) == v, F.col(value))).alias(v) for v in labels])


def against_reference(stats: DataFrame, reference: DataFrame) -> DataFrame:
    """Model statistic, literature value, difference."""
    return stats.join(reference, "metric").select(
        "metric", "model_value", "ref_value", (F.col("model_value") - F.col("ref_value")).alias("diff"))


def with_grid(df: DataFrame, **axes) -> DataFrame:
    """Every row times every combination of the given parameter values."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df
