"""Text helpers: display labels, short keys, feature families."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .calendar import _c


def display_label(name) -> Column:
    """Drop every bracketed remark, ASCII or full width, with the blanks before it."""
    return F.trim(F.regexp_replace(_c(name), r"\s*[(（][^)）]*[)）]", ""))


def short_key(label, mapping: dict[str, str]) -> Column:
    expr = F.lit(None).cast("string")
    for k, v in reversed(list(mapping.items())):
        expr = F.when(_c(label) == k, F.lit(v)).otherwise(expr)
    return expr


def feature_family(name) -> Column:
    """Family of a feature name: humidity ratio, slow mean, or fast lag."""
    n = _c(name)
    return (
        F.when(n.startswith("ratio"), "ratio")
        .when(n.contains("_ma"), "slow_ma")
        .otherwise("fast_lag")
    )


def percent_of_range(lo, hi, v) -> Column:
    """Position of ``v`` on the row's own [lo, hi] axis, in percent."""
    span = F.nullif(_c(hi) - _c(lo), F.lit(0.0))
    return (_c(v) - _c(lo)) / span * F.lit(100.0)
