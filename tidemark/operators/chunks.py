"""Time chunks with halo rows: bounded windows over series of any length.

``Window.partitionBy(series)`` puts a whole series in one task. Here a series is cut
into chunks of fixed length, each chunk also receives copies of the neighbouring rows
its frames need (the halo), and the copies are dropped afterwards. One shuffle on
(series, chunk); the result equals the uncut window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import HOUR, epoch_s

CHUNK_HOURS = 24 * 366


class Frames:
    """Window frames inside one chunk, measured in steps of time (default one hour)."""

    def __init__(self, keys, step=HOUR):
        self.step = step
        self.order = Window.partitionBy(*keys, "_chunk").orderBy("_e")

    def between(self, lo, hi):
        lo = Window.unboundedPreceding if lo is None else lo * self.step
        hi = Window.unboundedFollowing if hi is None else hi * self.step
        return self.order.rangeBetween(lo, hi)

    def at(self, col, offset) -> Column:
        """Value exactly ``offset`` steps away; null where that time has no row."""
        return F.first(col).over(self.between(offset, offset))

    def total(self, col, w) -> Column:
        """Sum over the last ``w`` steps as a difference of two running sums: O(n) for any ``w``."""
        z = F.lit(0)
        return (F.coalesce(F.sum(col).over(self.between(None, 0)), z)
                - F.coalesce(F.sum(col).over(self.between(None, -w)), z))

    def count(self, col, w) -> Column:
        return F.count(col).over(self.between(None, 0)) - F.count(col).over(self.between(None, -w))


def with_halo(df: DataFrame, ts="ts", back=0, ahead=0, step=HOUR, chunk=None) -> DataFrame:
    """Add ``_e`` (epoch seconds), ``_home`` and ``_chunk``; rows near a border appear once per chunk."""
    width = (chunk or max(CHUNK_HOURS * HOUR // step, back + ahead)) * step
    df = df.withColumn("_e", epoch_s(ts))

    def cell(e):
        return F.floor(e / F.lit(width)).cast("long")

    return df.withColumn("_home", cell(F.col("_e"))).withColumn(
        "_chunk",
        F.explode(F.sequence(cell(F.col("_e") - ahead * step), cell(F.col("_e") + back * step))),
    )


def without_halo(df: DataFrame) -> DataFrame:
    return df.where("_chunk = _home").drop("_e", "_home", "_chunk")


def windowed(df, keys, make, ts="ts", back=0, ahead=0, step=HOUR, chunk=None) -> DataFrame:
    """Append window columns. ``make(frames)`` returns {name: Column} with frames inside [-back, ahead]."""
    fr = Frames(keys, step)
    halo = with_halo(df, ts, back, ahead, step, chunk)
    return without_halo(halo.withColumns(make(fr)))


def positions(df, keys, ts="ts", tie=(), step=HOUR, chunk=None, name="pos") -> DataFrame:
    """0-based row number per key in time order, plus the key's row count ``n_rows``."""
    cut = with_halo(df, ts, 0, 0, step, chunk)
    per = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = per.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                     F.sum("_n").over(Window.partitionBy(*keys)).alias("n_rows"))
    local = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy("_e", *tie)) - 1
    return (cut.withColumn("_local", local).join(off, [*keys, "_chunk"])
            .withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_e", "_home", "_chunk", "_off", "_local"))


def complete_grid(df, keys, ts="ts", step_hours=1) -> DataFrame:
    """Every step between a key's first and last row; missing steps get nulls.

    The span is expanded in two steps, so no row ever holds an array longer than one chunk.
    """
    width = CHUNK_HOURS * HOUR
    span = df.groupBy(*keys).agg(F.min(epoch_s(ts)).alias("_lo"), F.max(epoch_s(ts)).alias("_hi"))
    step = step_hours * HOUR
    parts = span.withColumn("_a", F.explode(F.expr(f"sequence(_lo, _hi, {width // step * step}L)")))
    hours = parts.withColumn(
        "_s", F.explode(F.expr(f"sequence(_a, least(_hi, _a + {width // step * step - step}L), {step}L)")))
    frame = hours.select(*keys, F.timestamp_seconds("_s").cast("timestamp_ntz").alias(ts))
    return frame.join(df, [*keys, ts], "left")
