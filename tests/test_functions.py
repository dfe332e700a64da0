from math import pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import at, frame, series
from tidemark.functions import labels as L, scores as S
from tidemark.operators import alarms as A, climate as C
from tidemark.sources import stations


def test_isd_decode(spark):
    d = frame(spark, "v STRING", [("+0123,1",), ("+9999,9",), (None,), ("x,1",), ("",)])
    assert [r[0] for r in d.select(stations.decode(F.col("v"))).collect()] == [12.3, None, None, None, None]


def test_odd_quote_and_short_record(spark):
    lines = ['"A","B"', '"1","two, three"', '"1","bro"ken"', '"1"']
    d = frame(spark, "value STRING", [(x,) for x in lines])
    got = stations.parse_report_lines(d, ["A", "B"], keep=("A", "B")).collect()
    assert [tuple(r) for r in got] == [("1", "two, three")]


def test_threshold_crps_limit(spark):
    d = frame(spark, "m ARRAY<DOUBLE>, y DOUBLE", [([1.0, 2.0, 3.0], 2.0)])
    v = d.select(S.threshold_crps("m", "y", -100.0)).first()[0]
    assert v == pytest.approx(2 / 9)


@pytest.mark.parametrize("r", [-50.0, 55.0, 62.0, 70.0])
def test_threshold_crps_matches_integral(spark, r):
    rng = np.random.default_rng(3)
    m, y = rng.normal(60, 8, 64), 63.0
    grid = np.linspace(max(r, 0), 120, 400_001)
    f = np.searchsorted(np.sort(m), grid, side="right") / 64
    want = np.trapezoid((f - (grid >= y)) ** 2, grid)
    d = frame(spark, "m ARRAY<DOUBLE>, y DOUBLE", [([float(v) for v in m], y)])
    assert d.select(S.threshold_crps("m", "y", r)).first()[0] == pytest.approx(want, abs=2e-3)


def test_levels(spark):
    d = frame(spark, "v DOUBLE", [(61.9,), (62.0,), (67.0,), (75.0,)])
    assert [r[0] for r in d.select(A.raw_level("v")).collect()] == [0, 1, 1, 2]


def test_weight_modes(spark):
    d = frame(spark, "x DOUBLE", [(67.0,)])
    taus = (0.5, 0.9)
    none, fixed, op = [d.select(S.tail_weights("x", F.lit(0), taus, gamma=2.0, mode=m)).first()[0] for m in ("none", "fixed", "operator")]
    assert none == [1.0, 1.0] and fixed == pytest.approx([1.0, 1.8]) and op == pytest.approx(fixed)


def test_harmonic_peak(spark):
    d = series(spark, range(240), [np.cos(2 * pi * (h - 5) / 24) for h in range(240)])
    r = C.harmonic_fit(d, ["series_id"], "x", 24.0).first()
    assert r["amplitude"] == pytest.approx(1) and r["peak_h"] == pytest.approx(5)


def test_circular_mean(spark):
    d = frame(spark, "h DOUBLE", [(23.75,), (0.25,)])
    v = d.agg(C.circular_hour(F.col("h"))).first()[0]
    assert min(v, 24 - v) == pytest.approx(0, abs=1e-9)


def test_display_label(spark):
    d = frame(spark, "n STRING", [("Operator (full)（draft）",), ("plain",)])
    assert [r[0] for r in d.select(L.display_label("n")).collect()] == ["Operator", "plain"]


def test_daily_range_uses_local_days(spark):
    rows = [("a", at(h), float(h % 24), 2.0 * (h % 24)) for h in range(24 * 15)]
    d = frame(spark, "series_id STRING, ts TIMESTAMP_NTZ, i DOUBLE, o DOUBLE", rows)
    r = C.daily_range_ratio(d, ["series_id"], "i", "o", "Asia/Shanghai").first()
    assert r["n_days"] == 16 and r["range_ratio"] == pytest.approx(0.5)
