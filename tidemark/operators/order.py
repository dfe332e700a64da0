"""Global order per key without gathering a key in one task.

Rows are range-partitioned on (key, order value) and staged; running sums are then a
local window per (key, range partition) plus the totals of earlier range partitions.
A key that holds a third of all rows is spread over a third of the partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage


def ranged(df: DataFrame, keys, order, parts=None) -> DataFrame:
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id()))


def running_totals(df, keys, order, sums: dict[str, str], parts=None) -> DataFrame:
    """Add, for each ``out: col`` in ``sums``, the total of ``col`` over earlier rows of the key."""
    st = ranged(df, keys, order, parts)
    before = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = st.withColumns({f"_l_{o}": F.coalesce(F.sum(c).over(before), F.lit(0)) for o, c in sums.items()})
    tot = st.groupBy(*keys, "_pid").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_pid", *[
        F.coalesce(F.sum(f"_t_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in sums])
    out = local.join(off, [*keys, "_pid"])
    for o in sums:
        out = out.withColumn(o, F.col(f"_l_{o}") + F.col(f"_o_{o}")).drop(f"_l_{o}", f"_o_{o}")
    return out.drop("_pid")


def directory(st: DataFrame, keys, count="_c") -> DataFrame:
    """(keys, _pid, _off, _here, _n) of ranged rows: how many come before, are in and belong to each key's range partitions.

    One row per key and partition; the rows themselves are only counted.
    """
    d = st.groupBy(*keys, "_pid").agg(F.sum(count).alias("_here"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return d.select(*keys, "_pid", "_here", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_off"), F.sum("_here").over(whole).alias("_n"))


def sent(df: DataFrame, row_bytes: int = 256, limit: int = 64 << 20) -> DataFrame:
    """``df`` staged, as the side that is sent if its rows (about ``row_bytes`` each) fit ``limit``."""
    df = stage(df)
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def quantiles(df, keys, value, targets: DataFrame, frac="q", out="quantile", parts=None) -> DataFrame:
    """Exact linear-interpolated quantiles; ``targets`` holds key columns and a fraction per row.

    Values are counted first (map-side combine), so repeated values cost nothing and only distinct values are ordered.
    The directory of range partitions tells which ones hold a wanted rank; only their rows are read again and ranked.
    ``targets`` may carry further label columns.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    counts = clean.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    st = ranged(counts, keys, ["_v"], parts)
    pos = F.col(frac) * (F.col("_n") - 1)
    d = directory(st, keys).join(targets, list(keys)).withColumn("_pos", pos).withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos"))
    last = F.col("_off") + F.col("_here")
    holds = ((F.col("_lo") >= F.col("_off")) & (F.col("_lo") < last)) | ((F.col("_hi") >= F.col("_off")) & (F.col("_hi") < last))
    wanted = stage(d.where(holds))  # two rows per target at most
    here = [*keys, "_pid"]
    read = st.join(wanted.select(*here).distinct(), here, "left_semi")
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy(*here).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = read.withColumn("_in", inside).join(wanted, here).withColumn("_b", F.col("_off") + F.col("_in"))
    end = F.col("_b") + F.col("_c")
    picked = hit.where((F.col("_hi") >= F.col("_b")) & (F.col("_lo") < end)).groupBy(*targets.columns, "_pos", "_lo").agg(
        F.max(F.when((F.col("_lo") >= F.col("_b")) & (F.col("_lo") < end), F.col("_v"))).alias("_a"),
        F.max(F.when((F.col("_hi") >= F.col("_b")) & (F.col("_hi") < end), F.col("_v"))).alias("_z"))
    w = F.col("_pos") - F.col("_lo")
    return picked.select(*targets.columns, (F.col("_a") + (F.col("_z") - F.col("_a")) * w).alias(out))


def fixed_quantiles(df, keys, value, fracs: dict[str, float]) -> DataFrame:
    """Quantiles at given fractions, one column per name in ``fracs``."""
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q"))
                               for n, q in fracs.items()]))
    targets = df.groupBy(*keys).agg(F.count("*").alias("_rows")).select(*keys, grid.alias("g")).select(*keys, "g.*")
    got = quantiles(df, keys, value, targets)
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("quantile"))).alias(n) for n in fracs])
