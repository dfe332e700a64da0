"""Vectors consumed inside their blocks, array-shaped forecasts, cuts by radix selection: against the long-table forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import frame
from tidemark.operators import alarms as A, features as X, linear as L, paths as P
from tidemark.operators.moments import grams

SPEC = X.FeatureSpec(drivers=("t_c", "rh"), lags=3, windows=(4,), ratio=False)
HS = (0, 1, 5)


@pytest.fixture(scope="module")
def series(spark):
    """Two series of 400 hours with gaps, in three parts."""
    rng, rows = np.random.default_rng(2), []
    for s in ("a", "b"):
        for h in range(400):
            if rng.random() > 0.05:
                x = 60 + 12 * np.sin(h / 9) + rng.normal()
                rows.append((s, "pooled", "train" if h < 200 else "val" if h < 300 else "test", h, float(x / 4), float(x), float(x + 3 * rng.normal())))
    df = frame(spark, "series_id STRING, model_id STRING, split STRING, h INT, t_c DOUBLE, rh DOUBLE, y DOUBLE", rows)
    return df.withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)")).drop("h")


def long(moments, keys):
    return {tuple(r[k] for k in (*keys, "h", "i")): np.array(r["g"]) for r in moments.collect()}


@pytest.mark.parametrize("chunk", [50, 10_000])
def test_moments_inside_the_blocks(series, chunk):
    group = ["model_id", "split"]
    a = long(X.feature_moments(series, ["series_id"], group, SPEC, ("y", HS), chunk=chunk), group)
    f = X.build_features(series, ["series_id"], SPEC, labels=("y", HS), carry=("model_id", "split"))
    b = long(grams(f, group, z="psi"), group)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in b)


def test_sums_inside_the_blocks(series):
    got = {r.series_id: r for r in X.feature_sums(series, ["series_id"], SPEC, chunk=64).collect()}
    f = X.build_features(series, ["series_id"], SPEC).toPandas()
    for s, d in f.groupby("series_id"):
        assert got[s].n_rows == len(d) and got[s].total == pytest.approx(np.vstack(d["psi"].to_list()).sum(axis=0))


@pytest.fixture(scope="module")
def scored(series):
    g = X.feature_moments(series, ["series_id"], ["model_id", "split"], SPEC, ("y", HS)).where("split = 'train'").drop("split")
    m = L.solve_ridge(g, ["model_id"], HS).select("model_id", F.lit("linear").alias("readout"), "horizon_h", "w_raw", "b_raw")
    m = m.unionByName(m.withColumns({"readout": F.lit("up"), "b_raw": F.col("b_raw") + 4}))
    return m, X.score_features(series, ["series_id"], m, ["model_id"], SPEC, ("y", HS), ["readout", "horizon_h"], carry=("split",), chunk=80)


def flat(rows):
    """One row per (origin, readout, step)."""
    step = F.get(F.array(*[F.lit(h) for h in HS]), F.col("i") % 3)
    x = rows.select("series_id", "ts", "split", "labels", F.posexplode("preds").alias("i", "y_pred"))
    return x.select("series_id", F.col("ts").alias("origin_ts"), "split", F.when(F.col("i") < 3, "linear").otherwise("up").alias("model"), step.alias("horizon_h"),
                    F.get("labels", F.col("i") % 3).alias("y_true"), "y_pred")


def test_scores_equal_the_join(series, scored):
    m, rows = scored
    f = X.build_features(series, ["series_id"], SPEC, carry=("model_id",))
    want = {(r.series_id, r.ts, r.readout, r.horizon_h): r.y_pred for r in L.score(f, m, ["model_id"]).collect()}
    got = {(r.series_id, r.origin_ts, r.model, r.horizon_h): r.y_pred for r in flat(rows).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_cuts_and_scan_equal_the_long_table(scored):
    _, rows = scored
    cuts = P.path_cuts(rows.where("split = 'val'"))
    x = flat(rows)
    want = A.level_cuts(x.where("split = 'val'"), ["model", "horizon_h"])
    for r in want.collect():
        k = ["linear", "up"].index(r.model) * 3 + HS.index(r.horizon_h)
        assert cuts[:, k] == pytest.approx([r.cut_62, r.cut_67, r.cut_75], abs=2e-6)
    test = rows.where("split = 'test'").withColumnRenamed("ts", "origin_ts")
    got = P.scan_paths(P.level_paths(test, cuts, ["linear", "up"], HS), ["series_id", "origin_ts"], ["linear", "up"], HS)
    ref = A.scan_origins(A.with_levels(x.where("split = 'test' AND y_true IS NOT NULL"), want, ["model", "horizon_h"]), ["series_id", "model"])
    names = ["series_id", "model", "origin_ts", "first_true_h", "first_alarm_h", "lead_h", "n_alarm", "n_true", "crosses"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, ref.select(*names).collect())) and got.count() > 20


def test_radix_ranks(spark):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(300, 4)) * 10, 1)
    v[:, 1] = -np.abs(v[:, 1])
    v[:5, 2], v[5:9, 3] = 0.0, -0.0
    v[::7, 0] = np.nan
    rows = frame(spark, "preds ARRAY<DOUBLE>, labels ARRAY<DOUBLE>", [([None if np.isnan(x) else float(x) for x in r], [1.0, None if k % 11 == 0 else 1.0]) for k, r in enumerate(v)]).repartition(3)
    ok = np.isfinite(v) & (np.arange(300)[:, None] % 11 != 0 if False else np.tile(np.column_stack([np.ones(300, bool), np.arange(300) % 11 != 0]), (1, 2)))
    want = np.array([[np.sort(v[ok[:, j], j])[r] for r in (0, 17, 150, ok[:, j].sum() - 1)] for j in range(4)])
    got = P.array_ranks(rows, np.array([[0, 17, 150, ok[:, j].sum() - 1] for j in range(4)], float))
    assert got == pytest.approx(want, abs=0) and np.isnan(P.array_ranks(rows, np.full((4, 1), np.nan))).all()
    assert P.path_cuts(rows.limit(0)).shape == (3, 0)
    assert (P.path_cuts(rows, thresholds=(2.0, 0.5, 99.0))[[0, 2]] == [[2.0], [99.0]]).all()


def test_no_model_and_too_many(series, scored):
    m, _ = scored
    assert X.score_features(series, ["series_id"], m.limit(0), ["model_id"], SPEC, None, ["readout", "horizon_h"]).where("size(preds) > 0").count() == 0
    big = m.limit(1).withColumn("w_raw", F.array_repeat(F.lit(0.0), 9_000_000))
    with pytest.raises(ValueError, match="bytes of models"):
        X.score_features(series, ["series_id"], big, ["model_id"], SPEC, None, ["readout", "horizon_h"])
