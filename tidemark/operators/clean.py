"""Cleaning, splits and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from .chunks import positions


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares above every number in Spark; missing values must be null."""
    cols = {f.name: F.nullif(F.col(f.name), F.lit(float("nan")).cast(f.dataType))
            for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.withColumns(cols) if cols else df


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the smallest by ``order``: an aggregate, so a hot key combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def quality_report(df: DataFrame, cols) -> DataFrame:
    long = df.unpivot([], list(cols), "variable", "v")
    return long.groupBy("variable").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("v").isNull()).alias("missing"),
        F.round(F.avg(F.col("v").isNull().cast("double")), 4).alias("missing_rate"),
        F.round(F.min("v"), 3).alias("min"), F.round(F.avg("v"), 3).alias("mean"), F.round(F.max("v"), 3).alias("max"))


def paired(df: DataFrame, a="y_true", b="y_pred") -> DataFrame:
    ok = [F.col(c).isNotNull() & ~F.isnan(c) for c in (a, b)]
    return df.where(ok[0] & ok[1])


def split_by_fraction(df: DataFrame, keys, ts="ts", train=60, val=20) -> DataFrame:
    """Train/val/test by row share of each key, in time order (shares in percent)."""
    p = positions(df, keys, ts)
    n_tr = F.floor(F.col("n_rows") * train / 100)
    n_va = F.floor(F.col("n_rows") * val / 100)
    return p.withColumn("split", F.when(F.col("pos") < n_tr, "train")
                        .when(F.col("pos") < n_tr + n_va, "val").otherwise("test"))


def stride(df: DataFrame, keys, k, ts="ts") -> DataFrame:
    return positions(df, keys, ts).where(F.col("pos") % k == 0)


def valid_units(df: DataFrame, unit, cols, min_n) -> DataFrame:
    """Units (loggers) with at least ``min_n`` values in every listed column."""
    counts = df.groupBy(*unit).agg(*[F.count(c).alias(f"n_{c}") for c in cols])
    for c in cols:
        counts = counts.where(F.col(f"n_{c}") >= min_n)
    return counts


def best_unit(df: DataFrame, keys, unit, n) -> DataFrame:
    """Best-covered unit per key; the smaller unit wins ties."""
    best = F.min(F.struct((-F.col(n)).alias("neg"), F.col(unit).alias("u"))).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, F.col("b.u").alias(unit), (-F.col("b.neg")).alias(n))


def domain_guards(df: DataFrame, domain, target, min_rows, min_std) -> DataFrame:
    """Per-domain counts with a verdict: kept, too_few or flat."""
    stats = df.groupBy(*domain).agg(F.count(target).alias("n_rows"), F.stddev_pop(target).alias("target_sd"))
    return stats.withColumn(
        "reason", F.when(F.col("n_rows") < min_rows, "too_few").when(F.col("target_sd") < min_std, "flat").otherwise("kept"))


def kept_domains(df: DataFrame, guards: DataFrame, domain) -> DataFrame:
    return df.join(guards.where(F.col("reason") == "kept"), domain, "left_semi")


def dropped_domains(df: DataFrame, guards: DataFrame, domain) -> DataFrame:
    return df.select(*domain).distinct().join(guards.where(F.col("reason") == "kept"), domain, "left_anti")


def backfill_warmup(df: DataFrame, keys, cols, ts="ts") -> DataFrame:
    """Leading nulls of a column take the column's first valid value; later gaps stay null."""
    aggs = []
    for c in cols:
        has = F.col(c).isNotNull()
        aggs += [F.min(F.when(has, F.col(ts))).alias(f"_t_{c}"),
                 F.min_by(F.when(has, F.col(c)), F.when(has, F.col(ts))).alias(f"_v_{c}")]
    out = df.join(df.groupBy(*keys).agg(*aggs), keys)
    for c in cols:
        out = out.withColumn(c, F.when(F.col(ts) < F.col(f"_t_{c}"), F.col(f"_v_{c}")).otherwise(F.col(c)))
    return out.select(*df.columns)


def column_check(df: DataFrame, required) -> DataFrame:
    """Finite share per required column; a missing column is an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return (df.unpivot([], list(required), "variable", "v").groupBy("variable")
            .agg(F.avg((F.col("v").isNotNull() & ~F.isnan("v")).cast("double")).alias("finite_share")))


def unit_summary(df: DataFrame, unit, cols) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"n_{c}"), F.min(c).alias(f"min_{c}"), F.avg(c).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}")]
    return df.groupBy(*unit).agg(*aggs)


def with_and_without_spinup(df: DataFrame, keys, col, lo, hi, ts="ts") -> DataFrame:
    """Statistics on the evaluation span next to those of the whole driven span."""
    inside = (F.col(ts) >= lo) & (F.col(ts) < hi)
    x = F.when(inside, F.col(col))
    return df.groupBy(*keys).agg(
        F.count(x).alias("n_eval"), F.avg(x).alias("mean_eval"), F.min(x).alias("min_eval"), F.max(x).alias("max_eval"),
        F.count(col).alias("n_all"), F.avg(col).alias("mean_all"), F.min(col).alias("min_all"), F.max(col).alias("max_all"))

