"""Logger cubes: one array of readings per logger and time axis, to long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.physics import kelvin_to_c


def cube_to_long(cube: DataFrame, logger="logger", axis="times", temp_k="temp_k", rh="rh", carry=()) -> DataFrame:
    """Explode parallel arrays by position; Kelvin to Celsius; NaN to null."""
    nan = F.lit(float("nan"))
    rows = cube.select(logger, *carry, F.explode(F.arrays_zip(axis, temp_k, rh)).alias("r"))
    return rows.select(logger, *carry, F.col(f"r.{axis}").alias("ts"),
                       kelvin_to_c(F.nullif(F.col(f"r.{temp_k}"), nan)).alias("temp_c"),
                       F.nullif(F.col(f"r.{rh}"), nan).alias("rh"))


def site_index(onehot):
    """0-based index of the one in a one-hot array; -1 if there is none."""
    return (F.array_position(onehot, F.lit(1)) - 1).cast("int")
