"""Sorting, top-k and nearest-row selections. Limits appear only where a top-k is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .chunks import positions


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    """First ``k`` rows of an order; Spark keeps k rows per task, no global sort."""
    return df.orderBy(*order).limit(k)


def nearest_to(df: DataFrame, keys, value, targets: DataFrame, target="quantile", tie="ts", payload=()) -> DataFrame:
    """Per key and target the row whose value is closest; the smaller ``tie`` wins."""
    cols = [c for c in targets.columns if c not in keys]
    j = df.join(targets, keys)
    best = F.min(F.struct(F.abs(F.col(value) - F.col(target)).alias("_d"), F.col(tie), F.col(value), *payload)).alias("_b")
    picked = j.groupBy(*keys, *cols).agg(best)
    return picked.select(*keys, *cols, F.col(f"_b.{tie}"), F.col(f"_b.{value}"), *[F.col(f"_b.{c}") for c in payload])


def last_hours(df: DataFrame, keys, hours, ts="ts") -> DataFrame:
    """Rows within the last ``hours`` of each key."""
    end = df.groupBy(*keys).agg(F.max(ts).alias("_end"))
    return df.join(end, keys).where(F.col(ts) > F.timestamp_add("HOUR", F.lit(-hours), "_end")).drop("_end")


def decimate(df: DataFrame, keys, target_rows, ts="ts") -> DataFrame:
    """Every k-th row with k = max(1, n // target): at most about ``target_rows`` points per key."""
    p = positions(df, keys, ts)
    k = F.greatest(F.lit(1), F.floor(F.col("n_rows") / target_rows))
    return p.where(F.col("pos") % k == 0).drop("pos", "n_rows")


def in_order(tables: list[DataFrame]) -> DataFrame:
    """Union by name with an ``ord`` column that keeps the order of the inputs."""
    out = None
    for i, d in enumerate(tables):
        d = d.withColumn("ord", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return out
