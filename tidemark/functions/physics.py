"""Moist-air conversions as Column expressions (whole-stage codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .calendar import _c

# Published saturation-pressure calibrations (scale in Pa, slope, offset in degC).
MAGNUS_ALDUCHOV = (610.94, 17.625, 243.04)
MAGNUS_SONNTAG = (611.2, 17.62, 243.12)
MAGNUS_BOLTON = (611.2, 17.67, 243.5)
# Gas constant of water vapour, freezing point, lapse rate, barometric exponent.
R_VAPOUR = 461.5
KELVIN = 273.15
LAPSE = 0.0065
BAROMETRIC = 5.257


def clip(x, lo, hi) -> Column:
    """Limit to [lo, hi]; null stays null (greatest/least alone would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def saturation_pa(t_c, coef=MAGNUS_ALDUCHOV) -> Column:
    scale, slope, offset = coef
    t = _c(t_c)
    return F.exp(F.lit(slope) * t / (F.lit(offset) + t)) * F.lit(scale)


def saturation_density(t_c) -> Column:
    return saturation_pa(t_c) / ((_c(t_c) + F.lit(KELVIN)) * F.lit(R_VAPOUR))


def vapour_density(rh, t_c) -> Column:
    return clip(rh, 0, 100) / F.lit(100.0) * saturation_density(t_c)


def relative_humidity(density, t_c) -> Column:
    return clip(_c(density) / saturation_density(t_c) * F.lit(100.0), 0, 100)


def humidity_from_dew(t_c, dew_c, coef=MAGNUS_BOLTON) -> Column:
    return clip(saturation_pa(dew_c, coef) / saturation_pa(t_c, coef) * F.lit(100.0), 0, 100)


def station_pressure(sea_level_hpa, t_c, height_m=1140.0) -> Column:
    """Sea-level pressure reduced to a station ``height_m`` above it."""
    drop = F.lit(LAPSE * height_m)
    ratio = F.lit(1.0) - drop / (_c(t_c) + F.lit(KELVIN) + drop)
    return _c(sea_level_hpa) * F.pow(ratio, F.lit(BAROMETRIC))


def kelvin_to_c(k) -> Column:
    return _c(k) - F.lit(KELVIN)


def kpa_to_hpa(p) -> Column:
    return _c(p) * F.lit(10.0)


def scenario_flow(open_flag, rain, q_open, q_closed, rain_gain) -> Column:
    """Volume flow: open or closed value, raised while it rains."""
    base = F.when(open_flag, F.lit(float(q_open))).otherwise(F.lit(float(q_closed)))
    return base * F.when(_c(rain) > 0, F.lit(1.0 + rain_gain)).otherwise(F.lit(1.0))


def air_changes(flow, volume_m3) -> Column:
    return _c(flow) / F.lit(float(volume_m3))
