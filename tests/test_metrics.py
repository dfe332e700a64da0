import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import at, forecasts, frame
from tidemark.operators import joins as J, metrics as M, order as O
from tidemark.operators.alarms import demo_candidates

K = ["series_id"]
KT = ["series_id", "threshold"]


def test_r2(spark):
    r = M.regression_metrics(forecasts(spark, [1, 2, 3], [11, 12, 13]), K).first()
    assert r["r2"] == pytest.approx(-149)
    assert M.regression_metrics(forecasts(spark, [5, 5], [1, 2]), K).first()["r2"] is None


def test_event_counts(spark):
    r = M.event_metrics(forecasts(spark, [70, 70, 1, 1], [70, 1, 70, 1]), K).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)


def test_auc(spark):
    d = frame(spark, "series_id STRING, y INT, y_pred DOUBLE", [("t", 0, .5), ("t", 1, .5), ("t", 0, .2), ("t", 1, .9), ("z", 0, .1), ("z", 0, .2)])
    got = {r["series_id"]: r["auc"] for r in M.exact_auc(d, K, F.col("y") == 1).collect()}
    assert got == {"t": 0.875, "z": None}


def test_auc_invariant_under_monotone_map(spark):
    rng = np.random.default_rng(0)
    rows = [("a", int(rng.random() < 0.3), float(np.round(rng.normal(), 1))) for _ in range(500)]
    d = frame(spark, "series_id STRING, y INT, y_pred DOUBLE", rows)
    a, b = [M.exact_auc(x, K, F.col("y") == 1).first()["auc"] for x in (d, d.withColumn("y_pred", F.exp("y_pred") * 3))]
    assert a == pytest.approx(b)
    s, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    pairs = s[y == 1][:, None] - s[y == 0][None, :]
    assert a == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean())


def test_cut(spark):
    d = forecasts(spark, [70, 70, 70, 1, 1, 1, 1, 1, 1, 1], [1, 1, 2, 2, 3, 3, 4, 4, 5, 5])
    want = float(np.quantile([1, 1, 2, 2, 3, 3, 4, 4, 5, 5], 0.7))
    assert M.calibrate_cuts(d, KT).first()["cut"] == pytest.approx(want)
    quiet = M.calibrate_cuts(forecasts(spark, [1, 2], [3, 4]), KT).first()
    assert quiet["cut"] == 62.0


def test_quantiles_with_hot_key(spark):
    """One key holds most rows and few values another; results equal NumPy."""
    rng = np.random.default_rng(5)
    data = {"hot": rng.normal(size=3000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.0])}
    d = frame(spark, "k STRING, v DOUBLE", [(k, float(x)) for k, xs in data.items() for x in xs])
    t = frame(spark, "k STRING, q DOUBLE", [(k, q) for k in data for q in (0.0, 0.31, 0.9999, 1.0)])
    for r in O.quantiles(d, ["k"], "v", t).collect():
        assert r["quantile"] == pytest.approx(np.quantile(data[r["k"]], r["q"]))


def test_running_totals_spread_a_hot_key(spark):
    d = spark.range(2000).selectExpr("'hot' AS k", "id AS o", "1 AS c")
    st = O.ranged(d, ["k"], ["o"], 4)
    assert st.select("_pid").distinct().count() == 4
    got = O.running_totals(d, ["k"], ["o"], {"b": "c"}, 4)
    assert got.where("b <> o").count() == 0


def lead(spark, y, p):
    return M.lead_time(forecasts(spark, y, p), K).first()


def test_lead_window(spark):
    y, p = [0] * 120, [0] * 120
    y[100], p[40], p[90] = 70, 70, 70
    r = lead(spark, y, p)
    assert (r["n_onset"], r["n_warned"], r["mean_lead_h"]) == (1, 1, 60.0)


def test_lead_early_onset_and_row0(spark):
    y, p = [0] * 120, [70] * 120
    y[50] = 70
    assert lead(spark, y, p)["n_warned"] == 0 and lead(spark, y, p)["n_onset"] == 1
    y = [70, 70] + [0] * 100
    assert lead(spark, y, p[:102])["n_onset"] == 1


def duration(spark, y, p):
    d = forecasts(spark, y, p)
    return M.duration_metrics(M.block_hours(d, K), K).first()


def test_duration_miss_and_false_alarm(spark):
    r = duration(spark, [70] * 5 + [0] * 19, [0] * 24)
    assert (r["hit_window"], r["joint_dur_mae_h"], r["cond_dur_mae_h"]) == (0.0, 5.0, None)
    r = duration(spark, [0] * 24, [70] * 3 + [0] * 21)
    assert (r["joint_dur_mae_h"], r["false_alarm_h"]) == (3.0, 3.0)


def test_unfinished_block_is_dropped(spark):
    assert duration(spark, [70] * 30, [70] * 30)["n_window"] == 1


def asof(spark, left, right, tol=1800, **kw):
    l = frame(spark, "series_id STRING, ts TIMESTAMP_NTZ", [("a", at(h)) for h in left])
    r = frame(spark, "series_id STRING, rts TIMESTAMP_NTZ, v DOUBLE", [("a", at(h), float(h)) for h in right])
    return [x["v"] for x in J.asof_nearest(l, r, K, "ts", "rts", tol, **kw).orderBy("ts").collect()]


def test_asof_tie_and_edge(spark):
    assert asof(spark, [10.5], [10, 11]) == [10.0]
    assert asof(spark, [10 + 31 / 60], [10]) == [None]
    assert asof(spark, [10.5], [10]) == [10.0]


@pytest.mark.parametrize("splits", [1, 7, 64])
def test_asof_against_brute_force(spark, splits):
    rng = np.random.default_rng(splits)
    left = sorted(np.round(rng.uniform(0, 30, 200), 3)) + [4.0, 4.0]
    right = sorted(set(np.round(rng.uniform(0, 30, 60), 3)) | {4.0})

    def best(x):
        c = min(right, key=lambda r: (abs(round(r * 3.6e9) - round(x * 3.6e9)), r))
        return c if abs(c - x) <= 0.5 + 1e-9 else None

    assert asof(spark, left, right, splits=splits) == [best(x) for x in sorted(left)]


def test_candidates_fall_back(spark):
    schema = "series_id STRING, n_alarm LONG, lead_h INT, n_true LONG, crosses INT"
    weak = frame(spark, schema, [("a", 1, 1, 1, 1), ("b", 2, 0, 1, 1)])
    got = demo_candidates(weak).collect()
    assert len(got) == 2 and {r["crosses"] for r in got} == {0}
    strong = demo_candidates(weak.unionByName(frame(spark, schema, [("c", 9, 20, 9, 1)]))).collect()
    assert [(r["series_id"], r["crosses"]) for r in strong] == [("c", 1)]


def test_quantiles_of_one_key_read_few_partitions(spark):
    """One key over all range partitions: rows are read again only where the directory finds a wanted rank."""
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=20_000), 3)
    d = frame(spark, "series_id STRING, y DOUBLE", [("a", float(x)) for x in v]).repartition(4)
    t = frame(spark, "series_id STRING, q DOUBLE, name STRING", [("a", q, f"q{q}") for q in (0.0, 0.3, 0.5, 0.999, 1.0)])
    df = O.quantiles(d, K, "y", t, parts=16)
    got = {r.q: r.quantile for r in df.collect()}
    assert all(got[q] == pytest.approx(np.quantile(v, q)) for q in got) and len(got) == 5
    counts = d.groupBy("series_id", F.col("y").alias("_v")).agg(F.count("*").alias("_c"))
    held = O.directory(O.ranged(counts, K, ["_v"], 16), K).collect()
    assert len(held) > 8 and all(r._n == 20_000 for r in held) and sorted(r._off for r in held)[0] == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "_pid" in plan


def test_issue_time_lead(spark):
    """Horizons 24 and 48: an onset alarmed by the longer one leads by 48 hours, never by more; a repeated hour is no onset."""
    rows = []
    for h, preds in ((24, {10: 70, 11: 70, 30: 1, 50: 70}), (48, {10: 1, 11: 70, 30: 1, 50: 70})):
        rows += [("a", h, at(v), 70.0, float(p), 62.0, 65.0) for v, p in preds.items()] + [("a", h, at(v), 1.0, 70.0, 62.0, 65.0) for v in (9, 29, 49)]
    d = frame(spark, "series_id STRING, horizon_h INT, valid_ts TIMESTAMP_NTZ, y_true DOUBLE, y_pred DOUBLE, threshold DOUBLE, cut DOUBLE", rows)
    r = M.issue_time_lead(d, KT).first()
    assert (r.n_onset, r.n_warned, r.mean_issue_lead_h) == (3, 2, 36.0)
