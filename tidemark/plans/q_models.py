"""Model fitting and scoring (L1-L20, S9) and transfer across domains."""

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.calendar import DAY, HOUR, add_hours, day_floor, epoch_s, hour_floor
from ..operators import climate as C, domains as D, features as X, linear as L, metrics as M, paths as P
from ..operators.chunks import windowed
from ..operators.clean import split_by_fraction
from ..operators.moments import vector_stats
from ..session import checkpoint_dir, stage
from ..sources.models import fingerprint, load_or_fit
from .q_features import lag_sql, vector_rows
from .q_sources import S
from .registry import R, query, r6
from .series import split_of

SPEC = X.FeatureSpec(drivers=("t_c", "rh", "wind"), lags=6, windows=(24, 72))
HS = (0, 24, 48, 72)
LEADS = HS[1:]
IS_TRAIN = "split = 'train'"


def feats(t, horizons=HS, spec=SPEC, key="model_id"):
    """Features and leads of every series, pooled under one model key or one per series."""
    m = t.met()
    f = X.build_features(m, S, spec, labels=("y", horizons)).withColumn("split", split_of("ts"))
    return stage(f.withColumn("model_id", F.lit("pooled")) if key == "model_id" else f)


def fit(f, horizons=HS, keys=("model_id",), **kw):
    return L.fit_ridge(f.where(IS_TRAIN), list(keys), horizons, **kw)


def truth(f, horizons=HS):
    """Long labels: one row per (row, horizon)."""
    return f.select("model_id", "series_id", "ts", "split", "psi", F.posexplode("labels").alias("_i", "y_true")).select(
        "*", F.get(F.array(*[F.lit(h) for h in horizons]), F.col("_i")).alias("horizon_h")).drop("_i")


def scored_models(f, models, horizons=HS):
    return L.score(truth(f, horizons), models.drop("mu", "sigma", "w", "b0", "n", "beta"), ["model_id", "horizon_h"])


def weights(models, keys=("model_id",)):
    return r6(models.select(*keys, "horizon_h", "n", "b0", F.posexplode("w").alias("idx", "w")))


@query("l1_ridge")
def l1(t):
    """Same-hour ridge: distributed moments, small solve."""
    return weights(fit(feats(t, (0,)), (0,)))


@query("l2_multi_horizon")
def l2(t):
    return weights(fit(feats(t)))


TWO = X.FeatureSpec(drivers=("t_c", "rh"), lags=1, windows=(), slow=False, ratio=False)
TWO_SQL = f"""WITH z AS (SELECT series_id, ts, (t_c - avg(t_c) OVER ())/stddev_pop(t_c) OVER () AS z1, (rh - avg(rh) OVER ())/stddev_pop(rh) OVER () AS z2 FROM met WHERE ts < TIMESTAMP '2024-01-11'),
    m AS (SELECT h.horizon_h, count(*) AS n, avg(z1) AS m1, avg(z2) AS m2, avg(f.y) AS my, var_pop(z1) + 0.5 AS c11, var_pop(z2) + 0.5 AS c22, covar_pop(z1, z2) AS c12, covar_pop(f.y, z1) AS c1, covar_pop(f.y, z2) AS c2
      FROM z CROSS JOIN (SELECT unnest([0, 24, 48, 72]) AS horizon_h) h JOIN met f ON f.series_id = z.series_id AND f.ts = z.ts + to_hours(h.horizon_h) GROUP BY 1),
    w AS (SELECT *, (c1*c22 - c2*c12)/(c11*c22 - c12*c12) AS w1, (c2*c11 - c1*c12)/(c11*c22 - c12*c12) AS w2 FROM m)
    SELECT horizon_h, n, {R('w1')} AS w1, {R('w2')} AS w2, {R('my - w1*m1 - w2*m2')} AS b0 FROM w"""


@query("l2_two_driver_ridge", TWO_SQL)
def l2b(t):
    """Two drivers: the solve has a closed form, so SQL can check the moments and the missing labels."""
    m = fit(feats(t, HS, TWO))
    return r6(m.select("horizon_h", "n", F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2"), "b0"))


@query("l3_expectile")
def l3(t):
    """Asymmetric squares at three horizons and two levels, all in the same passes."""
    m = L.fit_reweighted(feats(t, LEADS).where(IS_TRAIN), LEADS, (0.9, 0.95), kind="expectile")
    return r6(m.select("horizon_h", "tau", "b0", "converged", F.posexplode("w").alias("idx", "w")))


@query("l4_quantile")
def l4(t):
    m = L.fit_reweighted(feats(t, LEADS).where(IS_TRAIN), LEADS, (0.9, 0.95), kind="quantile")
    return r6(m.select("horizon_h", "tau", "b0", F.posexplode("w").alias("idx", "w")))


L5_SQL = f"""WITH lg AS ({lag_sql(['t_c', 'rh'], 6)}) SELECT series_id, ts, h.horizon_h, {R('10e0 + sum(v/((pos + 1)*(1 + h.horizon_h)))')} AS y_pred
    FROM lg CROSS JOIN (SELECT unnest([0, 24]) AS horizon_h) h GROUP BY 1, 2, 3"""


@query("l5_score", L5_SQL)
def l5(t):
    """Stored weight vectors joined to features: one dot product per (row, horizon)."""
    f = X.build_features(t.met(), S, X.FeatureSpec(drivers=("t_c", "rh"), lags=6, windows=(), slow=False, ratio=False))
    rows = [("pooled", h, [1.0 / ((i + 1) * (1 + h)) for i in range(12)], 10.0) for h in (0, 24)]
    models = t.spark.createDataFrame(rows, "model_id STRING, horizon_h INT, w_raw ARRAY<DOUBLE>, b_raw DOUBLE")
    return r6(L.score(f.withColumn("model_id", F.lit("pooled")), models, ["model_id"]).select("series_id", "ts", "horizon_h", "y_pred"))


@query("l6_select_beta")
def l6(t):
    return r6(L.select_beta(feats(t), ["model_id"], HS, (1e-3, 1e-2, 0.1, 0.5, 1.0)))


@query("l7_qr_ridge")
def l7(t):
    """Per-site ridge through stacked QR factors, one model per site and horizon."""
    f = truth(feats(t, LEADS, key="series_id").withColumn("model_id", F.col("series_id")), LEADS).where(IS_TRAIN).where("y_true IS NOT NULL")
    m = L.ridge_by_qr(f.select("series_id", F.col("horizon_h").alias("lead_h"), "psi", F.col("y_true").alias("y")), ["series_id", "lead_h"], 1e-3)
    return r6(m.select("series_id", "lead_h", "n", "b0", "condition", F.posexplode("w").alias("idx", "w")), 5)


@query("l8_hour_ridge")
def l8(t):
    """Current-hour baseline: drivers only, unnormalised penalty that includes the intercept."""
    m = t.met()
    f = m.select("series_id", "ts", F.array("t_c", "rh", "rain", "wind", "p_hpa").alias("psi"), F.array("y").alias("labels"),
                 split_of("ts").alias("split"), F.lit("pooled").alias("model_id"))
    return weights(fit(f, (0,), beta=1.0, penalise_intercept=True, normalise=False))


FO = """SELECT m.series_id, k.k AS lag_h, CASE WHEN m.ts < TIMESTAMP '2024-01-11' THEN 'train' WHEN m.ts < TIMESTAMP '2024-01-21' THEN 'val' ELSE 'test' END AS split, b.rh AS x, m.y
    FROM met m CROSS JOIN (SELECT unnest(range(0, 7)) AS k) k JOIN met b ON b.series_id = m.series_id AND b.ts = m.ts - to_hours(CAST(k.k AS INT))"""


@query("l9_first_order", f"""WITH p AS ({FO}), c AS (SELECT series_id, lag_h, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p WHERE split = 'train' GROUP BY 1, 2),
    v AS (SELECT series_id, CAST(lag_h AS INT) AS lag_h, any_value(a) AS a, any_value(b) AS b, 1 - avg((y - a*x - b)*(y - a*x - b))/var_pop(y) AS val_r2 FROM p JOIN c USING (series_id, lag_h) WHERE split = 'val' GROUP BY 1, 2)
    SELECT series_id, lag_h, {R('a')} AS a, {R('b')} AS b, {R('val_r2')} AS val_r2, first_value(lag_h) OVER (PARTITION BY series_id ORDER BY round(val_r2, 9) DESC, lag_h) AS best_lag FROM v""")
def l9(t):
    return r6(L.first_order(t.met_core().withColumn("split", split_of("ts")), S, "rh", "y", range(7)))


AR = """SELECT series_id, n, a, b, my - a*mu - b*mv AS c FROM (SELECT *, (yu*vv - yv*uv)/(uu*vv - uv*uv) AS a, (yv*uu - yu*uv)/(uu*vv - uv*uv) AS b FROM (
    SELECT m.series_id, count(*) AS n, avg(m.y) AS my, avg(p.y) AS mu, avg(x.rh) AS mv, var_pop(p.y) AS uu, var_pop(x.rh) AS vv, covar_pop(p.y, x.rh) AS uv, covar_pop(m.y, p.y) AS yu, covar_pop(m.y, x.rh) AS yv
    FROM met m JOIN met p ON p.series_id = m.series_id AND p.ts = m.ts - INTERVAL 1 HOUR JOIN met x ON x.series_id = m.series_id AND x.ts = m.ts - INTERVAL 3 HOUR GROUP BY 1))"""


@query("l10_autoregressive", f"WITH ar AS ({AR}) SELECT series_id, n, {R('a')} AS a, {R('b')} AS b, {R('c')} AS c FROM ar")
def l10(t):
    return r6(L.autoregressive(t.met_core(), S, "rh", "y", 3).select("series_id", "n", "a", "b", "c"))


@query("l10_direct_forecast", f"""WITH ar AS ({AR}) SELECT m.series_id, m.ts, {R('a*m.y + b*x.rh + c')} AS y_pred, f.y AS y_true FROM met m JOIN ar USING (series_id)
    JOIN met x ON x.series_id = m.series_id AND x.ts = m.ts + INTERVAL 21 HOUR JOIN met f ON f.series_id = m.series_id AND f.ts = m.ts + INTERVAL 24 HOUR""")
def l10d(t):
    m = t.met_core()
    p = L.transfer_direct(m, stage(L.autoregressive(m, S, "rh", "y", 3)), S, "rh", "y", 24, 3)
    return r6(p.where("y_true IS NOT NULL AND y_pred IS NOT NULL").select("series_id", "ts", "y_pred", "y_true"))


@query("l11_reanchored", f"""WITH ar AS ({AR}), g AS (SELECT m.series_id, m.ts, m.y AS y0, j.j, x.rh FROM met m CROSS JOIN (SELECT unnest(range(1, 7)) AS j) j JOIN met x ON x.series_id = m.series_id AND x.ts = m.ts + to_hours(CAST(j.j - 3 AS INT)))
    SELECT g.series_id, g.ts, f.y AS y_true, {R('pow(any_value(a), 6)*any_value(y0) + sum(pow(a, 6 - j)*(b*g.rh + c))', 5)} AS y_pred FROM g JOIN ar USING (series_id) JOIN met f ON f.series_id = g.series_id AND f.ts = g.ts + INTERVAL 6 HOUR
    GROUP BY 1, 2, 3 HAVING count(*) = 6""")
def l11(t):
    m = t.met_core()
    p = L.transfer_reanchored(m, stage(L.autoregressive(m, S, "rh", "y", 3)), S, "rh", "y", 6, 3)
    return r6(p.select("series_id", "ts", "y_true", "y_pred"), 5)


@query("l11_daily_anchor", f"""WITH ar AS ({AR}), o AS (SELECT m.series_id, m.ts, date_trunc('day', m.ts) AS t0, hour(m.ts) + 6 AS s FROM met m),
    g AS (SELECT o.*, j.j, x.rh, a.y AS y0 FROM o JOIN (SELECT unnest(range(1, 30)) AS j) j ON j.j <= o.s JOIN met x ON x.series_id = o.series_id AND x.ts = o.t0 + to_hours(CAST(j.j - 3 AS INT)) JOIN met a ON a.series_id = o.series_id AND a.ts = o.t0)
    SELECT g.series_id, g.ts, 6 AS horizon_h, f.y AS y_true, {R('pow(any_value(a), s)*any_value(g.y0) + sum(pow(a, s - j)*(b*g.rh + c))', 5)} AS y_pred FROM g JOIN ar USING (series_id)
    JOIN met f ON f.series_id = g.series_id AND f.ts = g.ts + INTERVAL 6 HOUR GROUP BY g.series_id, g.ts, f.y, s HAVING count(*) = s""")
def l11b(t):
    m = t.met_core()
    return r6(L.transfer_reanchored(m, stage(L.autoregressive(m, S, "rh", "y", 3)), S, "rh", "y", 6, 3, rebase=24), 5)


@query("l12_recursive_rollout", f"""WITH RECURSIVE ar AS ({AR}), o AS (SELECT m.series_id, m.ts, m.y, m.rh, a, b, c, row_number() OVER (PARTITION BY m.series_id ORDER BY m.ts) AS rn FROM met m JOIN ar USING (series_id)),
    rec AS (SELECT series_id, ts, rn, y AS y_true, a*y + b*rh + c AS y_pred FROM o WHERE rn = 1
      UNION ALL SELECT o.series_id, o.ts, o.rn, o.y, o.a*rec.y_pred + o.b*o.rh + o.c FROM rec JOIN o ON o.series_id = rec.series_id AND o.rn = rec.rn + 1)
    SELECT series_id, ts, y_true, {R('y_pred', 5)} AS y_pred FROM rec""")
def l12(t):
    m = t.met_core()
    return r6(L.recursive_rollout(m, stage(L.autoregressive(m, S, "rh", "y", 3)), S, "rh", "y", chunk_hours=240), 5)


@query("l13_baselines", """SELECT series_id, model, horizon_h, origin_ts, y_true, y_pred FROM fc WHERE model <> 'mean24' UNION ALL
    SELECT f.series_id, 'held_driver', f.horizon_h, f.origin_ts, f.y_true, h.held FROM fc f JOIN (SELECT series_id, arg_min(y, ts) AS held FROM met GROUP BY 1) h USING (series_id) WHERE f.model = 'persistence'""")
def l13(t):
    f = t.fc()
    held = t.met_core().groupBy("series_id").agg(F.min_by("y", "ts").alias("held"))
    cols = ["series_id", "model", "horizon_h", "origin_ts", "y_true", "y_pred"]
    const = f.where("model = 'persistence'").join(held, S).withColumn("model", F.lit("held_driver")).withColumn("y_pred", F.col("held"))
    return f.where("model <> 'mean24'").select(*cols).unionByName(const.select(*cols))


@query("l14_transition_rollout")
def l14(t):
    m = L.fit_transition(feats(t, (0,), key="series_id").where(IS_TRAIN), S, (6, 24))
    return r6(m.select("series_id", "horizon_h", "b0", F.posexplode("w").alias("idx", "w")))


@query("l15_modes")
def l15(t):
    return r6(L.mode_table(feats(t, (0,), key="series_id").where(IS_TRAIN), S), 4)


@query("l16_direct_vs_rollout")
def l16(t):
    """R2 on the test part: one readout per horizon against the rolled same-hour readout."""
    hs = (6, 12, 24, 48, 72)
    f = feats(t, (0, *hs), key="series_id").withColumn("model_id", F.col("series_id"))
    tr = f.where(IS_TRAIN)
    direct = L.fit_ridge(tr, ["model_id"], (0, *hs)).withColumn("kind", F.lit("direct"))
    roll = L.fit_transition(tr.drop("series_id").withColumnRenamed("model_id", "series_id"), S, hs).withColumnRenamed("series_id", "model_id").withColumn("kind", F.lit("rollout"))
    cols = ["model_id", "horizon_h", "kind", "w_raw", "b_raw"]
    both = stage(direct.select(*cols).unionByName(roll.select(*cols)))
    p = L.score(truth(f, (0, *hs)).where("split = 'test' AND horizon_h > 0"), both, ["model_id", "horizon_h"])
    return r6(M.regression_metrics(p, ["kind", "horizon_h"]).select("kind", "horizon_h", "n", "r2", "rmse"), 5)


#: Rows of a partition of the tree builder: every level of every tree is a job, and few rows need few tasks.
TREE_ROWS = 100_000


def boosted(t, horizons, trees, depth):
    """Trees and ridge on the same features, one model per horizon; no early stop, all trees are used. The horizons' jobs run side by side."""
    from pyspark.ml.regression import GBTRegressor

    f = feats(t, horizons)
    out = scored_models(f.where("split <> 'val'"), fit(f, horizons), horizons).where("split = 'test' AND y_true IS NOT NULL")
    out = out.select(F.lit("ridge").alias("readout"), "horizon_h", "series_id", "y_true", "y_pred")
    parts = max(1, -(-f.count() // TREE_ROWS))

    def grow(i):
        rows = f.select("series_id", "split", F.get("labels", F.lit(i)).alias("label"), array_to_vector("psi").alias("features")).where("label IS NOT NULL")
        model = GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=0.08, maxBins=255, seed=7).fit(rows.where(IS_TRAIN).coalesce(parts))
        return model.transform(rows.where("split = 'test'")).select(
            F.lit("trees").alias("readout"), F.lit(horizons[i]).alias("horizon_h"), "series_id", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))

    with ThreadPoolExecutor(len(horizons)) as pool:
        for grown in pool.map(grow, range(len(horizons))):
            out = out.unionByName(grown)
    return r6(M.regression_metrics(out, ["readout", "horizon_h", *S]).select("readout", "horizon_h", *S, "n", "rmse", "r2"), 5)


@query("l17_boosted_trees")
def l17(t):
    """Non-linear readout beside the linear one."""
    return boosted(t, LEADS, 300, 6)


@query("l18_driver_swap")
def l18(t):
    """The same readout with one driver exchanged, and with lags only."""
    out = None
    for name, spec in (("wind", SPEC), ("pressure", X.FeatureSpec(drivers=("t_c", "rh", "p_hpa"), lags=6, windows=(24, 72))),
                       ("lags_only", X.FeatureSpec(drivers=("t_c", "rh", "wind"), lags=6, windows=(), slow=False, ratio=False))):
        f = feats(t, (0, 24), spec)
        p = scored_models(f.where("split <> 'val'"), fit(f, (0, 24)), (0, 24)).where("split = 'test'")
        m = M.regression_metrics(p, ["horizon_h"]).withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return r6(out.select("variant", "horizon_h", "n", "rmse", "r2"), 5)


@query("l19_lag_order_check")
def l19(t):
    """Reading a spliced window newest-first reproduces the fitted readout; any other order does not."""
    spec = X.FeatureSpec(drivers=("t_c", "rh"), lags=6, windows=(), slow=False, ratio=False)
    f = feats(t, (0,), spec)
    m = fit(f, (0,)).select("model_id", "w_raw", "b_raw")
    row = F.array("t_c", "rh")
    d = windowed(t.met_core(), S, lambda fr: {"h": F.collect_list(row).over(fr.between(-6, -1)), "g": F.collect_list(row).over(fr.between(0, 0))}, back=6)
    w = X.splice_windows(d.where(F.size("h") == 6), F.col("h"), F.col("g"), 1, 6).withColumn("model_id", F.lit("pooled")).join(L.small_side(m), "model_id")

    def read(vec):
        return F.aggregate(F.zip_with(vec, "w_raw", lambda a, b: a * b), F.col("b_raw"), lambda a, v: a + v)

    n = 12
    flipped = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("window", F.lit(n - 2) - i + 2 * (i % 2)))
    want = L.score(f.select("model_id", "series_id", "ts", "psi"), m, ["model_id"]).select("series_id", "ts", F.col("y_pred").alias("ref"))
    j = w.select("series_id", "ts", read(F.col("window")).alias("newest_first"), read(flipped).alias("oldest_first")).join(want, ["series_id", "ts"])
    long = j.unpivot(["series_id", "ts", "ref"], ["newest_first", "oldest_first"], "variant", "p")
    return long.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("ref"))), 6).alias("mae"))


@query("l20_trajectory_readout")
def l20(t):
    """Same-hour readout applied at the valid time, where the drivers of that time are known."""
    return trajectory(feats(t, (0,)))


def trajectory(f):
    m = fit(f, (0,)).select("model_id", "w_raw", "b_raw")
    now = L.score(f.select("model_id", "series_id", F.col("ts").alias("valid_ts"), "psi", F.get("labels", F.lit(0)).alias("y_true")), m, ["model_id"])
    origin = f.where("split = 'test'").select("series_id", F.col("ts").alias("origin_ts"), F.explode(F.array(F.lit(24), F.lit(48))).alias("horizon_h"))
    j = origin.withColumn("valid_ts", add_hours("origin_ts", "horizon_h")).join(now, ["series_id", "valid_ts"])
    return r6(M.regression_metrics(j, ["horizon_h"]).select("horizon_h", "n", "rmse", "r2"), 5)


@query("s9_model_cache")
def s9(t):
    """First call fits and stores, the second finds the stored weights by fingerprint."""
    path = f"{checkpoint_dir(t.spark)}/models-{uuid.uuid4().hex}"
    f = feats(t, (24,))
    key = fingerprint(source=t.dir, split="2024-01-11", beta=0.5, spec=SPEC)
    _, hit1 = load_or_fit(t.spark, path, key, lambda: fit(f, (24,)))
    m, hit2 = load_or_fit(t.spark, path, key, lambda: fit(f, (24,)))
    return r6(m.select("fingerprint", "horizon_h", F.lit(hit1).alias("first_hit"), F.lit(hit2).alias("second_hit"), F.posexplode("w").alias("idx", "w")))


# ---- the full 258-column feature vector and all 73 horizons ---------------------------------

FULL = X.FeatureSpec(windows=(7, 14, 30, 90, 180, 365), step=DAY)
FIVE = ("t_c", "rh", "rain", "wind", "p_hpa")
WF = {w: f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (48, *FULL.windows)}
RHO = "(610.94e0*exp(17.625e0*{0}/(243.04e0+{0}))/(461.5e0*({0}+273.15e0)))"
#: Sum of (place in the vector) * value over the 240 lags: driver k at lag j has place 5 j + k, from 1.
BY_PLACE = " + ".join(f"5*(rn*sum({c}) OVER {WF[48]} - sum(rn*{c}) OVER {WF[48]}) + {k}*sum({c}) OVER {WF[48]}" for k, c in enumerate(FIVE, 1))
FULL_SQL = f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, rh/100e0*{RHO.format('t_c')} AS q FROM depots), m AS (SELECT series_id, ts, count(*) OVER {WF[48]} AS n, {' + '.join(f'sum({c}) OVER {WF[48]}' for c in FIVE)} AS lags, {BY_PLACE} AS by_place,
    {', '.join(f'avg(t_c) OVER {WF[w]} AS t{w}, avg(q) OVER {WF[w]} AS q{w}' for w in FULL.windows)} FROM d)
    SELECT series_id, count(*) AS n_rows, {R('avg(lags)', 4)} AS lags, {R('avg(by_place)/1000', 4)} AS lags_by_place, {R('avg(' + ' + '.join(f't{w} + q{w}' for w in FULL.windows) + ')', 5)} AS slow,
    {R('avg(' + ' + '.join(f"least(q{w}/{RHO.format(f't{w}')}*100e0, 120e0)" for w in FULL.windows) + ')', 5)} AS ratio FROM m WHERE n = 48 GROUP BY 1"""


@query("w4_full_vector", FULL_SQL)
def w4f(t):
    """258 columns per row (240 lags, 12 slow means, 6 ratios), summed where they are built; sums per family and by position."""
    def total(lo, n):
        return F.aggregate(F.slice("total", lo, n), F.lit(0.0), lambda a, v: a + v) / F.col("n_rows")

    by_place = F.aggregate(F.transform(F.slice("total", 1, 240), lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v) / F.col("n_rows") / 1000
    g = X.feature_sums(t.depots(), S, FULL)
    return g.select("series_id", "n_rows", F.round(total(1, 240), 4).alias("lags"), F.round(by_place, 4).alias("lags_by_place"),
                    F.round(total(241, 12), 5).alias("slow"), F.round(total(253, 6), 5).alias("ratio"))


@query("l2_all_horizons")
def l2f(t):
    """73 readouts on 258 columns from one moment pass; scored against the next part in time."""
    hs = tuple(range(73))
    src = t.depots().withColumns({"model_id": F.lit("pooled"), "split": F.when(F.year("ts") < 2000, "train").otherwise("test")})
    m = L.solve_and_test(X.feature_moments(src, S, ["model_id", "split"], FULL, ("y", hs)), ["model_id"], hs)
    return r6(m.select("horizon_h", "n", "b0", "n_test", "test_r2", F.aggregate("w", F.lit(0.0), lambda a, v: a + F.abs(v)).alias("l1_norm")))


# ---- two-driver variants with a closed form in SQL ------------------------------------------

SPLIT = "CASE WHEN {0} < TIMESTAMP '2024-01-11' THEN 'train' WHEN {0} < TIMESTAMP '2024-01-21' THEN 'val' ELSE 'test' END"
ZZ = f"""zz AS (SELECT m.series_id, m.ts, m.y, {SPLIT.format('m.ts')} AS split, (t_c - mu1)/sd1 AS z1, (rh - mu2)/sd2 AS z2 FROM met m CROSS JOIN
    (SELECT avg(t_c) AS mu1, stddev_pop(t_c) AS sd1, avg(rh) AS mu2, stddev_pop(rh) AS sd2 FROM met WHERE ts < TIMESTAMP '2024-01-11') s)"""
MOM = "count(*) AS n, avg(z1) AS m1, avg(z2) AS m2, avg(y) AS my, var_pop(z1) AS v1, var_pop(z2) AS v2, covar_pop(z1, z2) AS c12, covar_pop(y, z1) AS c1, covar_pop(y, z2) AS c2"
W1 = "(c1*(v2 + {b}) - c2*c12)/((v1 + {b})*(v2 + {b}) - c12*c12)"
W2 = "(c2*(v1 + {b}) - c1*c12)/((v1 + {b})*(v2 + {b}) - c12*c12)"


@query("l6_two_driver_beta", f"""WITH {ZZ}, lb AS (SELECT zz.split, z1, z2, f.y FROM zz JOIN met f ON f.series_id = zz.series_id AND f.ts = zz.ts + INTERVAL 24 HOUR), mo AS (SELECT {MOM} FROM lb WHERE split = 'train'),
    w AS (SELECT beta, {W1.format(b='beta')} AS w1, {W2.format(b='beta')} AS w2, m1, m2, my FROM mo CROSS JOIN (SELECT unnest([0.01e0, 1e0, 10e0]) AS beta)),
    v AS (SELECT beta, 1 - avg(pow(y - my - w1*(z1 - m1) - w2*(z2 - m2), 2))/var_pop(y) AS val_r2 FROM lb CROSS JOIN w WHERE split = 'val' GROUP BY 1)
    SELECT 24 AS horizon_h, beta, {R('val_r2')} AS val_r2, (SELECT arg_max(beta, val_r2) FROM v) AS best_beta FROM v""")
def l6b(t):
    return r6(L.select_beta(feats(t, (24,), TWO), ["model_id"], (24,), (0.01, 1.0, 10.0)).select("horizon_h", "beta", "val_r2", "best_beta"))


@query("l7_two_driver_qr", f"""WITH s AS (SELECT series_id, avg(t_c) AS mu1, stddev_pop(t_c) AS sd1, avg(rh) AS mu2, stddev_pop(rh) AS sd2 FROM met WHERE ts < TIMESTAMP '2024-01-11' GROUP BY 1),
    mo AS (SELECT series_id, {MOM} FROM (SELECT m.series_id, (t_c - mu1)/sd1 AS z1, (rh - mu2)/sd2 AS z2, y FROM met m JOIN s USING (series_id) WHERE ts < TIMESTAMP '2024-01-11') GROUP BY 1)
    SELECT series_id, n, {R(W1.format(b='0.25e0'))} AS w1, {R(W2.format(b='0.25e0'))} AS w2, {R('my')} AS b0 FROM mo""")
def l7b(t):
    f = feats(t, (0,), TWO, key="series_id").withColumn("y", F.get("labels", F.lit(0))).where(IS_TRAIN)
    m = L.ridge_by_qr(f, S, 0.25)
    return r6(m.select("series_id", "n", F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2"), "b0"))


@query("l8_two_driver_hour", f"""WITH {ZZ}, mo AS (SELECT {MOM} FROM zz WHERE split = 'train') SELECT n, {R(W1.format(b='1e0/n'))} AS w1, {R(W2.format(b='1e0/n'))} AS w2, {R('n*my/(n + 1)')} AS b0 FROM mo""")
def l8b(t):
    m = fit(feats(t, (0,), TWO), (0,), beta=1.0, penalise_intercept=True, normalise=False)
    return r6(m.select("n", F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2"), "b0"))


L14_SQL = f"""WITH z AS (SELECT series_id, ts, y, (t_c - avg(t_c) OVER w)/stddev_pop(t_c) OVER w AS z1, (rh - avg(rh) OVER w)/stddev_pop(rh) OVER w AS z2 FROM met WHERE ts < TIMESTAMP '2024-01-11' WINDOW w AS (PARTITION BY series_id)),
    mo AS (SELECT series_id, {MOM} FROM z GROUP BY 1), r AS (SELECT series_id, {W1.format(b='0.5e0')} AS w1, {W2.format(b='0.5e0')} AS w2, my FROM mo),
    g AS (SELECT a.series_id, avg(a.z1*a.z1) + 0.5 AS a11, avg(a.z2*a.z2) + 0.5 AS a22, avg(a.z1*a.z2) AS a12, avg(a.z1*b.z1) AS b11, avg(a.z1*b.z2) AS b12, avg(a.z2*b.z1) AS b21, avg(a.z2*b.z2) AS b22
      FROM z a JOIN z b ON b.series_id = a.series_id AND b.ts = a.ts + INTERVAL 1 HOUR GROUP BY 1),
    k AS (SELECT series_id, (a22*b11 - a12*b21)/d AS k11, (a11*b21 - a12*b11)/d AS k12, (a22*b12 - a12*b22)/d AS k21, (a11*b22 - a12*b12)/d AS k22 FROM (SELECT *, a11*a22 - a12*a12 AS d FROM g)),
    h1 AS (SELECT series_id, w1*k11 + w2*k21 AS u1, w1*k12 + w2*k22 AS u2, my, k11, k12, k21, k22 FROM r JOIN k USING (series_id))
    SELECT series_id, 1 AS horizon_h, {R('u1')} AS w1, {R('u2')} AS w2, {R('my')} AS b0 FROM h1 UNION ALL SELECT series_id, 2, {R('u1*k11 + u2*k21')}, {R('u1*k12 + u2*k22')}, {R('my')} FROM h1"""


@query("l14_two_driver_rollout", L14_SQL)
def l14b(t):
    """Rolled readouts w'K and w'K^2; the transition comes from moments of consecutive hours."""
    m = L.fit_transition(feats(t, (0,), TWO, key="series_id").where(IS_TRAIN), S, (1, 2))
    return r6(m.select("series_id", "horizon_h", F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2"), "b0"))


@query("l20_two_driver_trajectory", f"""WITH {ZZ}, mo AS (SELECT {MOM} FROM zz WHERE split = 'train'), w AS (SELECT {W1.format(b='0.5e0')} AS w1, {W2.format(b='0.5e0')} AS w2, my FROM mo),
    p AS (SELECT h.horizon_h, f.y AS y_true, my + w1*f.z1 + w2*f.z2 AS y_pred FROM zz o CROSS JOIN (SELECT unnest([24, 48]) AS horizon_h) h JOIN zz f ON f.series_id = o.series_id AND f.ts = o.ts + to_hours(h.horizon_h) CROSS JOIN w WHERE o.split = 'test')
    SELECT horizon_h, count(*) AS n, {R('sqrt(avg((y_pred-y_true)*(y_pred-y_true)))', 5)} AS rmse, {R('1 - avg((y_pred-y_true)*(y_pred-y_true))/var_pop(y_true)', 5)} AS r2 FROM p GROUP BY 1""")
def l20b(t):
    return trajectory(feats(t, (0,), TWO))


# ---- domains ------------------------------------------------------------------------------

TASK = ["horizon_h"]
DSPEC = X.FeatureSpec(drivers=("t_c", "rh"), lags=3, windows=(6, 24), ratio=False, mean_of=("t_c", "rh"))


def sites(t):
    """Hourly drivers of eight sites (users modulo 8)."""
    k = F.get_json_object("props", "$.k").cast("long")
    site = F.format_string("site%d", F.col("user_id") % 8)
    c = t.events.groupBy(site.alias("domain"), hour_floor("ts").alias("ts")).agg(
        F.avg("value").alias("v"), F.avg(k).alias("rh"), F.avg(F.col("user_id") % 100).alias("u"))
    return stage(c.select("domain", "ts", (F.col("v") / 4 - 10).alias("t_c"), "rh", ((F.col("rh") + F.col("u")) / 2).alias("y")))


def site_rows(t, horizons=(0, 6)):
    m = sites(t)
    f = X.build_features(m, ["domain"], DSPEC, labels=("y", horizons))
    f = split_by_fraction(f, ["domain"]).select("domain", "ts", "split", "psi", F.posexplode("labels").alias("_i", "y"))
    return m, f.where("y IS NOT NULL").withColumn("horizon_h", F.get(F.array(*[F.lit(h) for h in horizons]), F.col("_i"))).drop("_i")


def site_coords(m):
    """Coordinates that need no label: driver mean and daily amplitude."""
    h = C.harmonic_fit(m, ["domain"], "rh", 24.0, min_rows=50)
    return h.select("domain", F.explode(F.array(F.struct(F.lit("mean").alias("coord"), F.col("mean").alias("s")),
                                                F.struct(F.lit("amplitude").alias("coord"), F.col("amplitude").alias("s")))).alias("c")).select("c.coord", "domain", "c.s")


def site_fit(t, arms=D.ARMS, horizons=(0, 6), coord=None, **kw):
    m, f = site_rows(t, horizons)
    z, mom = D.domain_moments(f, TASK)
    coords = site_coords(m)
    if coord:
        coords = coords.where(F.col("coord") == coord)
    return z, stage(D.fit_domains(mom, coords, TASK, D.TransferSpec(arms=tuple(arms), **kw)))


def arm_scores(t, arms, coord="mean", **kw):
    z, models = site_fit(t, arms, coord=coord, **kw)
    s = D.score_domains(D.predict_domains(z, models, TASK, (0, 100)), models, TASK)
    return r6(s.select("horizon_h", "coord", "domain", "arm", "n", "beta", "inner_risk", "r2", "rmse", "nrmse", "error"), 5)


SITE_ROWS = """site AS (SELECT *, (rh + u)/2 AS y FROM (SELECT 'site' || (user_id % 8) AS domain, date_trunc('hour', ts) AS ts, avg(CAST(regexp_extract(props,'[0-9]+') AS DOUBLE)) AS rh, avg(user_id % 100) AS u FROM events GROUP BY 1, 2)),
    ok AS (SELECT domain, ts, row_number() OVER (PARTITION BY domain ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY domain) AS n_rows FROM (SELECT domain, ts, count(*) OVER (PARTITION BY domain ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW) AS c FROM site) WHERE c = 3),
    lab AS (SELECT CASE WHEN pos < floor(n_rows*0.6) THEN 'train' WHEN pos < floor(n_rows*0.6) + floor(n_rows*0.2) THEN 'val' ELSE 'test' END AS split, ok.domain, h.horizon_h, f.y FROM ok CROSS JOIN (SELECT unnest([0, 6]) AS horizon_h) h
      JOIN site f ON f.domain = ok.domain AND f.ts = ok.ts + to_hours(h.horizon_h))"""


@query("d1_domain_moments", f"WITH {SITE_ROWS} SELECT horizon_h, domain, split, count(*) AS n, {R('avg(y*y)', 4)} AS mean_y2, {R('avg(y)', 4)} AS mean_y FROM lab WHERE split <> 'test' GROUP BY 1, 2, 3")
def d1(t):
    """Rows, mean squared label and the label mean per domain and split, from the moment rows."""
    _, mom = D.domain_moments(site_rows(t)[1], TASK)
    n = mom.where("h = -1").groupBy("horizon_h", "domain", "split").agg(F.max(F.struct("i", F.element_at("g", -1))).alias("x"))
    b = mom.where("h = 0").select("horizon_h", "domain", "split", F.element_at("g", -1).alias("yy"), F.element_at("g", -2).alias("ysum"))
    j = n.select("horizon_h", "domain", "split", F.col("x.col2").alias("n")).join(b, ["horizon_h", "domain", "split"])
    return r6(j.select("horizon_h", "domain", "split", F.round("n").cast("long").alias("n"), (F.col("yy") / F.col("n")).alias("mean_y2"), (F.col("ysum") / F.col("n")).alias("mean_y")), 4)


for _id, _arm, _name in ((2, "pooled", "pooled"), (3, "nearest", "nearest"), (4, "group_dro", "group_dro"), (5, "vrex", "vrex"),
                         (7, "subspace", "subspace"), (8, "koopman", "generator"), (9, "oracle", "oracle")):
    query(f"d{_id}_{_name}_arm")(lambda t, a=_arm: arm_scores(t, [a]))


@query("d6_domain_heads")
def d6(t):
    """One readout per domain."""
    _, f = site_rows(t)
    f = f.where("split = 'train'").withColumn("labels", F.array("y"))
    m = L.fit_ridge(f.withColumnRenamed("horizon_h", "lead_h"), ["domain", "lead_h"], (0,), beta=1.0)
    return r6(m.select("domain", "lead_h", "n", "b0", F.posexplode("w").alias("idx", "w")))


@query("d10_inner_selection")
def d10(t):
    """What the source-side selection chose, per fold."""
    _, models = site_fit(t, ("subspace", "koopman", "pooled"), coord="mean")
    return r6(models.select("horizon_h", "domain", "arm", "beta", "dims", "shrink", "n_latent", "eig_absmax", "sv_ratio", "inner_risk"), 4)


@query("d11_fit_predict")
def d11(t):
    z, models = site_fit(t, ("pooled", "subspace"), horizons=(6,), coord="mean")
    return r6(D.predict_domains(z, models, TASK, (0, 100)).select("horizon_h", "coord", "domain", "arm", "ts", "y_true", "y_pred"), 4)


SITE_SQL = """SELECT 'site' || (user_id % 8) AS domain, date_trunc('hour', ts) AS ts, avg(CAST(regexp_extract(props,'[0-9]+') AS DOUBLE)) AS rh FROM events GROUP BY 1, 2"""


@query("d12_domain_coordinates", f"""WITH s AS ({SITE_SQL}), h AS (SELECT domain, avg(rh) AS mean, var_pop(c) AS cc, var_pop(d) AS ss, covar_pop(c, d) AS cs, covar_pop(rh, c) AS yc, covar_pop(rh, d) AS ys
      FROM (SELECT *, cos(2*pi()*hour(ts)/24) AS c, sin(2*pi()*hour(ts)/24) AS d FROM s) GROUP BY 1 HAVING count(*) >= 50),
    k AS (SELECT domain, mean, sqrt(pow((yc*ss - ys*cs)/(cc*ss - cs*cs), 2) + pow((ys*cc - yc*cs)/(cc*ss - cs*cs), 2)) AS amplitude FROM h)
    SELECT 'mean' AS coord, domain, {R('mean')} AS s FROM k UNION ALL SELECT 'amplitude', domain, {R('amplitude')} FROM k""")
def d12(t):
    return r6(site_coords(sites(t)))


@query("d13_leave_one_out")
def d13(t):
    """All arms and coordinates, summarised over folds."""
    z, models = site_fit(t)
    s = D.score_domains(D.predict_domains(z, models, TASK, (0, 100)), models, TASK)
    return r6(D.domain_summary(s, ["horizon_h", "coord", "arm"]), 5)


@query("d14_deployable_protocol")
def d14(t):
    z, models = site_fit(t, ("pooled", "subspace", "koopman"))
    s = D.score_domains(D.predict_domains(z, models, TASK, (0, 100)), models, TASK)
    return r6(D.deployable(s, ["horizon_h", "domain", "arm"]), 5)


@query("d15_year_domains")
def d15(t):
    """Years as domains: leave-one-year-out and forward in time, labels within the same year. Orders have days, so the leads 1/6/24/72 are days."""
    daily = t.orders.groupBy(day_floor("o_orderdate").alias("ts")).agg(F.count("*").cast("double").alias("n"), (F.sum("o_totalprice") / 1e6).alias("rev"))
    daily = stage(daily.withColumn("series_id", F.lit("all")))
    leads = (1, 6, 24, 72)
    spec = X.FeatureSpec(drivers=("n", "rev"), lags=7, windows=(7, 30), ratio=False, mean_of=("n", "rev"), step=DAY)
    f = X.build_features(daily, S, spec, labels=("n", leads))
    f = f.select(F.year("ts").cast("string").alias("domain"), "ts", "psi", F.posexplode("labels").alias("_i", "y"))
    f = f.withColumn("horizon_h", F.get(F.array(*[F.lit(24 * n) for n in leads]), F.col("_i"))).drop("_i")
    f = f.where((F.year("ts") == F.year(add_hours("ts", "horizon_h"))) & F.col("y").isNotNull())
    f = split_by_fraction(f, ["domain", "horizon_h"]).drop("pos", "n_rows")
    z, mom = D.domain_moments(f, TASK)
    coords = z.select("domain").distinct().select(F.lit("year").alias("coord"), "domain", F.col("domain").cast("double").alias("s"))
    out = None
    for protocol, least in (("interp", 3), ("forward", 4)):
        spec_p = D.TransferSpec(arms=("pooled", "nearest", "koopman", "subspace", "oracle"), scale="mean_of_domains", protocol=protocol, min_sources=least)
        models = stage(D.fit_domains(mom, coords, TASK, spec_p))
        s = D.score_domains(D.predict_domains(z, models, TASK), models, TASK).withColumn("protocol", F.lit(protocol))
        out = s if out is None else out.unionByName(s)
    return r6(out.select("protocol", "horizon_h", "domain", "arm", "n_sources", "n", "r2", "rmse", "nrmse", "error"), 4)


# ---- closed forms for cache, modes and transfer ---------------------------------------------

def _two(models, *keys):
    return r6(models.select(*keys, F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2"), "b0"))


@query("l1_two_driver_ridge", f"SELECT n, w1, w2, b0 FROM ({TWO_SQL}) WHERE horizon_h = 0")
def l1b(t):
    return _two(fit(feats(t, (0,), TWO), (0,)), "n")


@query("s9_two_driver_cache", f"SELECT horizon_h, false AS first_hit, true AS second_hit, w1, w2, b0 FROM ({TWO_SQL}) WHERE horizon_h = 24")
def s9b(t):
    """The stored weights that the second call finds are the closed form of the first call's fit."""
    path = f"{checkpoint_dir(t.spark)}/models-{uuid.uuid4().hex}"
    f = feats(t, (24,), TWO)
    key = fingerprint(source=t.dir, split="2024-01-11", beta=0.5, spec=TWO)
    _, hit1 = load_or_fit(t.spark, path, key, lambda: fit(f, (24,)))
    m, hit2 = load_or_fit(t.spark, path, key, lambda: fit(f, (24,)))
    return _two(m, "horizon_h", F.lit(hit1).alias("first_hit"), F.lit(hit2).alias("second_hit"))


L15_SQL = L14_SQL[: L14_SQL.index("h1 AS (")].rstrip().rstrip(",") + f""", e AS (SELECT series_id, k11 + k22 AS tr, k11*k22 - k12*k21 AS det, (k11 + k22)*(k11 + k22)/4 - (k11*k22 - k12*k21) AS disc FROM k),
    v AS (SELECT series_id, s, CASE WHEN disc < 0 THEN tr/2 ELSE tr/2 + s*sqrt(disc) END AS re, CASE WHEN disc < 0 THEN s*sqrt(-disc) ELSE 0e0 END AS im FROM e CROSS JOIN (SELECT unnest([1e0, -1e0]) AS s)),
    a AS (SELECT *, sqrt(re*re + im*im) AS size FROM v)
    SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY round(size, 12) DESC, im DESC) - 1 AS INT) AS mode, {R('size', 5)} AS abs_lambda, {R('-1/ln(size)', 4)} AS tau_hours,
    CASE WHEN im = 0 AND re > 0 THEN NULL ELSE {R('2*pi()/abs(atan2(im, re))', 4)} END AS period_hours FROM a WHERE size > 0 AND size < 1"""


@query("l15_two_driver_modes", L15_SQL)
def l15b(t):
    """Two drivers: the eigenvalues are roots of a quadratic. A mode that does not turn has no period."""
    m = L.mode_table(feats(t, (0,), TWO, key="series_id").where(IS_TRAIN), S)
    period = F.when(F.col("period_hours") < float("inf"), F.round("period_hours", 4))
    return m.select("series_id", "mode", F.round("abs_lambda", 5).alias("abs_lambda"), F.round("tau_hours", 4).alias("tau_hours"), period.alias("period_hours"))


TWO_SITE = """st AS (SELECT *, (x2 + u)/2 AS y FROM (SELECT 'site' || (user_id % 8) AS domain, date_trunc('hour', ts) AS ts, avg(value)/4 - 10 AS x1,
      avg(CAST(regexp_extract(props,'[0-9]+') AS DOUBLE)) AS x2, avg(user_id % 100) AS u FROM events GROUP BY 1, 2)),
    rw AS (SELECT domain, ts, x1, x2, y, CASE WHEN pos < floor(n_rows*0.6) THEN 'train' WHEN pos < floor(n_rows*0.6) + floor(n_rows*0.2) THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY domain) AS n_rows FROM st)),
    al AS (SELECT avg(x1) AS a1, stddev_pop(x1) AS d1, avg(x2) AS a2, stddev_pop(x2) AS d2 FROM rw), co AS (SELECT domain, avg(x2) AS s FROM st GROUP BY 1),
    fold AS (SELECT h.domain AS hold, avg(x1) AS mu1, stddev_pop(x1) AS sd1, avg(x2) AS mu2, stddev_pop(x2) AS sd2 FROM co h JOIN rw ON rw.domain <> h.domain WHERE split = 'train' GROUP BY 1),
    near AS (SELECT h.domain AS hold, arg_min(o.domain, abs(o.s - h.s)) AS pick FROM co h JOIN co o ON o.domain <> h.domain GROUP BY 1)"""
#: Which rows each arm fits on, for the held-out domain ``hold``.
ARM_ROWS = {"pooled": "rw.domain <> hold AND split <> 'test'", "nearest": "rw.domain = pick AND split <> 'test'", "oracle": "rw.domain = hold AND split = 'train'"}
DTWO = X.FeatureSpec(drivers=("t_c", "rh"), lags=1, windows=(), slow=False, ratio=False)


def _arm_sql(arm):
    return f"""WITH {TWO_SITE}, mo AS (SELECT hold, {MOM} FROM (SELECT hold, (x1 - mu1)/sd1 AS z1, (x2 - mu2)/sd2 AS z2, y FROM fold JOIN near USING (hold) JOIN rw ON {ARM_ROWS[arm]}) GROUP BY 1),
    w AS (SELECT hold, {W1.format(b='0.5e0')} AS w1, {W2.format(b='0.5e0')} AS w2, m1, m2, my FROM mo), r AS (SELECT hold, w1/sd1 AS r1, w2/sd2 AS r2, my - w1*m1 - w2*m2 - w1*mu1/sd1 - w2*mu2/sd2 AS b FROM w JOIN fold USING (hold))
    SELECT hold AS domain, '{arm}' AS arm, {R('r1*d1', 5)} AS w1, {R('r2*d2', 5)} AS w2, {R('b + r1*a1 + r2*a2', 5)} AS b0 FROM r CROSS JOIN al"""


def _two_fit(t, spec, coords="coord = 'mean'", features=DTWO):
    """Rows of the sites on a common scale and the models of every held-out site, for few drivers and hour 0."""
    m = sites(t)
    f = split_by_fraction(X.build_features(m, ["domain"], features, labels=("y", (0,))), ["domain"]).select(
        "domain", "ts", "split", "psi", F.get("labels", F.lit(0)).alias("y"), F.lit(0).alias("horizon_h"))
    z, mom = D.domain_moments(f.where("y IS NOT NULL"), TASK)
    return z, stage(D.fit_domains(mom, site_coords(m).where(coords), TASK, spec))


def _arm_two(t, arm, **spec):
    """Weights of one arm for every held-out site, on the scale of all rows, as two-driver closed forms."""
    _, models = _two_fit(t, D.TransferSpec(arms=(arm,), **{"betas": (0.5,), **spec}))
    return r6(models.select("domain", "arm", F.get("w_raw", F.lit(0)).alias("w1"), F.get("w_raw", F.lit(1)).alias("w2"), F.col("b_raw").alias("b0")), 5)


for _id, _arm in ((2, "pooled"), (3, "nearest"), (9, "oracle")):
    query(f"d{_id}_two_driver_{_arm}", _arm_sql(_arm))(lambda t, a=_arm: _arm_two(t, a))


@query("d6_two_driver_heads", f"""WITH {TWO_SITE}, s AS (SELECT domain, avg(x1) AS mu1, stddev_pop(x1) AS sd1, avg(x2) AS mu2, stddev_pop(x2) AS sd2 FROM rw WHERE split = 'train' GROUP BY 1),
    mo AS (SELECT domain, {MOM} FROM (SELECT rw.domain, (x1 - mu1)/sd1 AS z1, (x2 - mu2)/sd2 AS z2, y FROM rw JOIN s USING (domain) WHERE split = 'train') GROUP BY 1)
    SELECT domain, n, {R(W1.format(b='1e0'))} AS w1, {R(W2.format(b='1e0'))} AS w2, {R('my')} AS b0 FROM mo""")
def d6b(t):
    f = split_by_fraction(X.build_features(sites(t), ["domain"], DTWO, labels=("y", (0,))), ["domain"]).where(IS_TRAIN)
    return _two(L.fit_ridge(f, ["domain"], (0,), beta=1.0), "domain", "n")


# Heads of all sources (src) for every held-out site (hold), on the fold's scale.
HEADS = f"""hd AS (SELECT hold, src, w1, w2, my - w1*m1 - w2*m2 AS w0 FROM (SELECT hold, src, {W1.format(b='1e0')} AS w1, {W2.format(b='1e0')} AS w2, m1, m2, my FROM
      (SELECT hold, src, {MOM} FROM (SELECT hold, rw.domain AS src, (x1 - mu1)/sd1 AS z1, (x2 - mu2)/sd2 AS z2, y FROM fold JOIN rw ON rw.domain <> hold WHERE split <> 'test') GROUP BY 1, 2))),
    lg AS (SELECT hold, src, t.i, t.v, co.s, h.s AS s_at FROM hd CROSS JOIN (SELECT unnest([1, 2, 3]) AS i) u CROSS JOIN LATERAL (SELECT u.i AS i, CASE u.i WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w0 END AS v) t
      JOIN co ON co.domain = src JOIN co h ON h.domain = hold),
    kn AS (SELECT *, exp(-0.5*pow(s - s_at, 2)/var_pop(s) OVER (PARTITION BY hold, i)) AS k FROM lg),
    ag AS (SELECT hold, i, avg(v) AS mean, var_pop(v) AS var, regr_slope(v, s) AS slope, avg(s) AS ms, any_value(s_at) AS s_at, sum(k*v)/sum(k) AS near FROM kn GROUP BY 1, 2)"""


@query("d7_two_driver_subspace", f"""WITH {TWO_SITE}, {HEADS},
    rk AS (SELECT *, row_number() OVER (PARTITION BY hold ORDER BY var DESC, i) AS r FROM ag),
    ex AS (SELECT hold, i, CASE WHEN r <= 2 THEN 0.6e0*(mean + slope*(s_at - ms)) + 0.4e0*near ELSE mean END AS v FROM rk),
    w AS (SELECT hold, max(CASE WHEN i = 1 THEN v END) AS w1, max(CASE WHEN i = 2 THEN v END) AS w2, max(CASE WHEN i = 3 THEN v END) AS w0 FROM ex GROUP BY 1)
    SELECT hold AS domain, 'subspace' AS arm, {R('w1/sd1*d1', 5)} AS w1, {R('w2/sd2*d2', 5)} AS w2, {R('w0 + w1/sd1*(a1 - mu1) + w2/sd2*(a2 - mu2)', 5)} AS b0 FROM w JOIN fold USING (hold) CROSS JOIN al""")
def d7b(t):
    """Two of three weights follow their line along the site mean, mixed with their mean nearby; the third is a mean."""
    return _arm_two(t, "subspace", dims=(2,), shrinks=(0.6,))


DONE = X.FeatureSpec(drivers=("rh",), lags=1, windows=(), slow=False, ratio=False)
D8_SQL = f"""WITH {TWO_SITE}, hd AS (SELECT hold, src, w, my - w*m AS w0 FROM (SELECT hold, src, covar_pop(y, z)/(var_pop(z) + 0.5) AS w, avg(y) AS my, avg(z) AS m FROM
      (SELECT hold, rw.domain AS src, (x2 - mu2)/sd2 AS z, y FROM fold JOIN rw ON rw.domain <> hold WHERE split <> 'test') GROUP BY 1, 2)),
    c AS (SELECT hold, avg(w) AS aw, avg(w0) AS a0, var_pop(w) AS a, var_pop(w0) AS c, covar_pop(w, w0) AS m FROM hd GROUP BY 1),
    e AS (SELECT *, (a + c)/2 + sqrt(pow((a - c)/2, 2) + m*m) AS top FROM c),
    v AS (SELECT hold, aw, a0, m/sqrt(m*m + pow(top - a, 2)) AS e1, (top - a)/sqrt(m*m + pow(top - a, 2)) AS e0 FROM e),
    x AS (SELECT hold, src, co.s, (w - aw)*e1 + (w0 - a0)*e0 AS x FROM hd JOIN v USING (hold) JOIN co ON co.domain = src),
    p AS (SELECT hold, (x + nx)/2 AS h, (nx - x)/(ns - s) AS r FROM (SELECT *, lead(x) OVER q AS nx, lead(s) OVER q AS ns FROM x WINDOW q AS (PARTITION BY hold ORDER BY s, src)) WHERE nx IS NOT NULL),
    g AS (SELECT hold, sum(h*h) + 0.01 AS hh, sum(h) AS h, count(*) + 0.01 AS n, sum(r*h) AS rh, sum(r) AS r FROM p GROUP BY 1),
    k AS (SELECT hold, least((rh*n - r*h)/(hh*n - h*h), 0) AS a, (r*hh - rh*h)/(hh*n - h*h) AS d FROM g),
    t AS (SELECT x.hold, x.x, o.s - x.s AS t, exp(-0.5*pow(x.s - o.s, 2)/var_pop(x.s) OVER (PARTITION BY x.hold)) AS w, a, d FROM x JOIN co o ON o.domain = x.hold JOIN k ON k.hold = x.hold),
    f AS (SELECT hold, sum(w*(exp(a*t)*x + d*CASE WHEN a = 0 THEN t ELSE (exp(a*t) - 1)/a END))/sum(w) AS z FROM t GROUP BY 1)
    SELECT hold AS domain, 'koopman' AS arm, {R('(aw + e1*z)/sd2*d2', 5)} AS w1, {R('a0 + e0*z + (aw + e1*z)/sd2*(a2 - mu2)', 5)} AS b0 FROM f JOIN v USING (hold) JOIN fold USING (hold) CROSS JOIN al"""


@query("d8_one_driver_generator", D8_SQL)
def d8b(t):
    """One driver, one latent coordinate: the plane is an eigenvector of two by two, the flow an exponential."""
    _, models = _two_fit(t, D.TransferSpec(arms=("koopman",), betas=(0.5,), n_latent=1), features=DONE)
    return r6(models.select("domain", "arm", F.get("w_raw", F.lit(0)).alias("w1"), F.col("b_raw").alias("b0")), 5)


# Readouts on the drivers themselves: y = b + r1*x1 + r2*x2, per held-out site.
def _raw_sql(arm):
    return f"""mo AS (SELECT hold, {MOM} FROM (SELECT hold, (x1 - mu1)/sd1 AS z1, (x2 - mu2)/sd2 AS z2, y FROM fold JOIN near USING (hold) JOIN rw ON {ARM_ROWS[arm]}) GROUP BY 1),
    w AS (SELECT hold, {W1.format(b='0.5e0')} AS w1, {W2.format(b='0.5e0')} AS w2, m1, m2, my FROM mo),
    r AS (SELECT hold, w1/sd1 AS r1, w2/sd2 AS r2, my - w1*m1 - w2*m2 - w1*mu1/sd1 - w2*mu2/sd2 AS b FROM w JOIN fold USING (hold)),
    pr AS (SELECT rw.domain, ts, y AS y_true, least(greatest(b + r1*x1 + r2*x2, 0), 100) AS y_pred FROM rw JOIN r ON r.hold = rw.domain WHERE split = 'test')"""


@query("d11_two_driver_predict", f"WITH {TWO_SITE}, {_raw_sql('pooled')} SELECT domain, 'pooled' AS arm, ts, {R('y_true', 4)} AS y_true, {R('y_pred', 4)} AS y_pred FROM pr")
def d11b(t):
    """Fit on the other sites, predict the held-out site's last part, clipped."""
    z, models = _two_fit(t, D.TransferSpec(arms=("pooled",), betas=(0.5,)))
    return r6(D.predict_domains(z, models, TASK, (0, 100)).select("domain", "arm", "ts", "y_true", "y_pred"), 4)


D13_SQL = " UNION ALL ".join(f"""SELECT * FROM (WITH {TWO_SITE}, {_raw_sql(arm)}, sc AS (SELECT domain, 1 - avg(pow(y_pred - y_true, 2))/var_pop(y_true) AS r2, sqrt(avg(pow(y_pred - y_true, 2))/var_pop(y_true)) AS nrmse FROM pr GROUP BY 1)
    SELECT '{arm}' AS arm, count(*) AS folds, 0::BIGINT AS failed, {R('median(r2)', 5)} AS median_r2, {R('median(nrmse)', 5)} AS median_nrmse, count_if(r2 > 0)::BIGINT AS n_r2_pos, count_if(nrmse < 1)::BIGINT AS n_nrmse_ok FROM sc)"""
                             for arm in ("pooled", "nearest", "oracle"))


@query("d13_two_driver_summary", D13_SQL)
def d13b(t):
    """Leave one site out: medians and success counts over the folds of three arms."""
    z, models = _two_fit(t, D.TransferSpec(arms=("pooled", "nearest", "oracle"), betas=(0.5,)))
    s = D.score_domains(D.predict_domains(z, models, TASK, (0, 100)), models, TASK)
    return r6(D.domain_summary(s, ["arm"]), 5)


D14_SQL = f"""WITH {TWO_SITE}, hm AS (SELECT domain, avg(x2) AS mean, var_pop(c) AS cc, var_pop(d) AS ss, covar_pop(c, d) AS cs, covar_pop(x2, c) AS yc, covar_pop(x2, d) AS ys
      FROM (SELECT *, cos(2*pi()*hour(ts)/24) AS c, sin(2*pi()*hour(ts)/24) AS d FROM rw) GROUP BY 1),
    cx AS (SELECT 'mean' AS coord, domain, mean AS s FROM hm UNION ALL SELECT 'amplitude', domain, sqrt(pow((yc*ss - ys*cs)/(cc*ss - cs*cs), 2) + pow((ys*cc - yc*cs)/(cc*ss - cs*cs), 2)) FROM hm),
    nx AS (SELECT h.coord, h.domain AS hold, arg_min(o.domain, abs(o.s - h.s)) AS pick FROM cx h JOIN cx o ON o.coord = h.coord AND o.domain <> h.domain GROUP BY 1, 2),
    mo AS (SELECT coord, hold, last, {MOM} FROM (SELECT coord, hold, last, (x1 - mu1)/sd1 AS z1, (x2 - mu2)/sd2 AS z2, y FROM nx JOIN fold USING (hold) JOIN rw ON rw.domain = pick
      CROSS JOIN (SELECT unnest([false, true]) AS last) WHERE split = 'train' OR (last AND split = 'val')) GROUP BY 1, 2, 3),
    w AS (SELECT coord, hold, last, {W1.format(b='0.5e0')} AS w1, {W2.format(b='0.5e0')} AS w2, m1, m2, my FROM mo),
    vr AS (SELECT coord, hold, avg(mse) AS inner_risk FROM (SELECT coord, hold, rw.domain, avg(pow(y - my - w1*((x1 - mu1)/sd1 - m1) - w2*((x2 - mu2)/sd2 - m2), 2)) AS mse
      FROM w JOIN fold USING (hold) JOIN rw ON rw.domain <> hold WHERE NOT last AND split = 'val' GROUP BY 1, 2, 3) GROUP BY 1, 2),
    pr AS (SELECT coord, hold, y AS y_true, least(greatest(my + w1*((x1 - mu1)/sd1 - m1) + w2*((x2 - mu2)/sd2 - m2), 0), 100) AS y_pred FROM w JOIN fold USING (hold) JOIN rw ON rw.domain = hold WHERE last AND split = 'test'),
    sc AS (SELECT coord, hold, 1 - avg(pow(y_pred - y_true, 2))/var_pop(y_true) AS r2, sqrt(avg(pow(y_pred - y_true, 2))) AS rmse FROM pr GROUP BY 1, 2)
    SELECT hold AS domain, coord, {R('r2', 4)} AS r2, {R('rmse', 4)} AS rmse, {R('inner_risk', 4)} AS inner_risk FROM sc JOIN vr USING (coord, hold)
    QUALIFY row_number() OVER (PARTITION BY hold ORDER BY inner_risk, coord) = 1"""


@query("d14_two_driver_protocol", D14_SQL)
def d14b(t):
    """The coordinate whose nearest site has the smaller risk on the sources, per held-out site."""
    z, models = _two_fit(t, D.TransferSpec(arms=("nearest",), betas=(0.5,)), coords="true")
    s = D.score_domains(D.predict_domains(z, models, TASK, (0, 100)), models, TASK)
    return r6(D.deployable(s, ["domain", "arm"]).select("domain", "coord", "r2", "rmse", "inner_risk"), 4)


def _dro_sql():
    """Two steps: even weights, weights by the risks, and the readout of these weights."""
    mom = "sum(q*m1) AS m1, sum(q*m2) AS m2, sum(q*my) AS my, sum(q*e11) - pow(sum(q*m1), 2) AS v1, sum(q*e22) - pow(sum(q*m2), 2) AS v2, sum(q*e12) - sum(q*m1)*sum(q*m2) AS c12, sum(q*e1y) - sum(q*m1)*sum(q*my) AS c1, sum(q*e2y) - sum(q*m2)*sum(q*my) AS c2"
    w = f"{W1.format(b='0.5e0')} AS w1, {W2.format(b='0.5e0')} AS w2"
    return f"""WITH {TWO_SITE}, dm AS (SELECT hold, src, avg(z1) AS m1, avg(z2) AS m2, avg(y) AS my, avg(z1*z1) AS e11, avg(z2*z2) AS e22, avg(z1*z2) AS e12, avg(z1*y) AS e1y, avg(z2*y) AS e2y, avg(y*y) AS eyy
      FROM (SELECT hold, rw.domain AS src, (x1 - mu1)/sd1 AS z1, (x2 - mu2)/sd2 AS z2, y FROM fold JOIN rw ON rw.domain <> hold WHERE split <> 'test') GROUP BY 1, 2),
    f0 AS (SELECT hold, {w}, m1, m2, my FROM (SELECT hold, {mom} FROM (SELECT *, 1e0/count(*) OVER (PARTITION BY hold) AS q FROM dm) GROUP BY 1)),
    r0 AS (SELECT hold, src, w1*w1*e11 + w2*w2*e22 + b*b + 2*w1*w2*e12 + 2*w1*b*d.m1 + 2*w2*b*d.m2 - 2*(w1*e1y + w2*e2y + b*d.my) + eyy + 0.5*(w1*w1 + w2*w2) AS r
      FROM dm d JOIN (SELECT hold, w1, w2, my - w1*m1 - w2*m2 AS b FROM f0) USING (hold)),
    u AS (SELECT hold, src, greatest(exp(0.05*(r - max(r) OVER (PARTITION BY hold)))/count(*) OVER (PARTITION BY hold), 1e-6) AS u FROM r0),
    f1 AS (SELECT hold, {w}, m1, m2, my FROM (SELECT hold, {mom} FROM (SELECT dm.*, u.u/sum(u.u) OVER (PARTITION BY hold) AS q FROM dm JOIN u USING (hold, src)) GROUP BY 1))
    SELECT hold AS domain, 'group_dro' AS arm, {R('w1/sd1*d1', 5)} AS w1, {R('w2/sd2*d2', 5)} AS w2, {R('my - w1*m1 - w2*m2 + w1/sd1*(a1 - mu1) + w2/sd2*(a2 - mu2)', 5)} AS b0 FROM f1 JOIN fold USING (hold) CROSS JOIN al"""


@query("d4_two_step_dro", _dro_sql())
def d4b(t):
    """Two steps of the reweighting in closed form."""
    return _arm_two(t, "group_dro", dro_iters=2)


# ---- the alarm chain on fitted readouts: arrays per origin ----------------------------------

def fitted_paths(t, spec, steps, taus=()):
    """Origins with predictions of all fitted readouts and levels, and the readouts' names.

    Moments are summed where the vectors are built; the readouts score inside the same blocks.
    """
    src = t.met().withColumns({"model_id": F.lit("pooled"), "split": split_of("ts")})
    g = stage(X.feature_moments(src, S, ["model_id", "split"], spec, ("y", steps)).where(IS_TRAIN).drop("split"))
    models = L.solve_ridge(g, ["model_id"], steps).select("model_id", F.lit("linear").alias("readout"), "horizon_h", "w_raw", "b_raw")
    if taus:
        train = X.build_features(src, S, spec, labels=("y", steps), carry=("split",)).where(IS_TRAIN)
        asym = L.fit_reweighted(train, steps, taus).select(F.lit("pooled").alias("model_id"), F.format_string("tau%d", F.round(F.col("tau") * 100).cast("int")).alias("readout"), "horizon_h", "w_raw", "b_raw")
        models = models.unionByName(asym)
    models = stage(models)
    rows = stage(X.score_features(src, S, models, ["model_id"], spec, ("y", steps), ["readout", "horizon_h"], carry=("split",)))
    names = sorted({r for r, _ in P.readout_names(models, ["readout", "horizon_h"])})
    cuts = P.path_cuts(rows.where("split = 'val'"))
    return P.level_paths(rows.where("split = 'test'").withColumnRenamed("ts", "origin_ts"), cuts, names, steps), names


SCAN3_SQL = f"""WITH {ZZ}, lb AS (SELECT zz.series_id, zz.ts, zz.split, z1, z2, h.horizon_h, f.y FROM zz CROSS JOIN (SELECT unnest([24, 48, 72]) AS horizon_h) h LEFT JOIN met f ON f.series_id = zz.series_id AND f.ts = zz.ts + to_hours(h.horizon_h)),
    mo AS (SELECT horizon_h, {MOM} FROM lb WHERE split = 'train' AND y IS NOT NULL GROUP BY 1), w AS (SELECT horizon_h, {W1.format(b='0.5e0')} AS w1, {W2.format(b='0.5e0')} AS w2, m1, m2, my FROM mo),
    pr AS (SELECT series_id, ts, split, horizon_h, y AS y_true, my + w1*(z1 - m1) + w2*(z2 - m2) AS y_pred FROM lb JOIN w USING (horizon_h)),
    va AS (SELECT horizon_h, thr, y_pred, row_number() OVER (PARTITION BY horizon_h, thr ORDER BY y_pred) - 1 AS rn, count(*) OVER (PARTITION BY horizon_h, thr) AS n, avg(CASE WHEN y_true >= thr THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY horizon_h, thr) AS rate
      FROM pr CROSS JOIN (SELECT unnest([62e0, 67e0, 75e0]) AS thr) WHERE split = 'val' AND y_true IS NOT NULL),
    ps AS (SELECT *, (1 - rate)*(n - 1) AS pos FROM va),
    cu AS (SELECT horizon_h, thr, round(CASE WHEN max(rate) > 0 THEN max(CASE WHEN rn = floor(pos) THEN y_pred END) + (max(CASE WHEN rn = ceil(pos) THEN y_pred END) - max(CASE WHEN rn = floor(pos) THEN y_pred END))*(max(pos) - floor(max(pos))) ELSE thr END, 6) AS cut FROM ps GROUP BY 1, 2),
    c3 AS (SELECT horizon_h, max(cut) FILTER (thr = 62) AS c62, max(cut) FILTER (thr = 67) AS c67, max(cut) FILTER (thr = 75) AS c75 FROM cu GROUP BY 1),
    lv AS (SELECT pr.*, CASE WHEN y_pred >= c75 THEN 2 WHEN y_pred >= c67 OR y_pred >= c62 THEN 1 ELSE 0 END AS level FROM pr JOIN c3 USING (horizon_h) WHERE split = 'test' AND y_true IS NOT NULL)
    SELECT series_id, ts AS origin_ts, 'linear' AS model, min(horizon_h) FILTER (y_true >= 62) AS first_true_h, min(horizon_h) FILTER (level >= 1) AS first_alarm_h, count(*) FILTER (level >= 1) AS n_alarm, count(*) FILTER (y_true >= 62) AS n_true,
    {R('max(y_true)')} AS true_peak, {R('max(y_pred)', 5)} AS pred_peak, min(horizon_h) FILTER (y_true >= 62) - min(horizon_h) FILTER (level >= 1) AS lead_h, CASE WHEN max(y_pred) >= 62 THEN 1 ELSE 0 END AS crosses
    FROM lv GROUP BY 1, 2 HAVING count(*) FILTER (level >= 1) > 0 AND count(*) FILTER (y_true >= 62) > 0"""


@query("a5_two_driver_scan", SCAN3_SQL)
def a5two(t):
    """Features, ridge, cuts on the validation part, levels and the origin scan, end to end: every step has a closed form."""
    rows, names = fitted_paths(t, TWO, (24, 48, 72))
    s = P.scan_paths(rows, ["series_id", "origin_ts"], names, (24, 48, 72))
    return s.withColumns({"true_peak": F.round("true_peak", 6), "pred_peak": F.round("pred_peak", 5)})


@query("a5_readout_scan")
def a5all(t):
    """The same with the full hourly readouts: 73 steps, the linear one and two asymmetric ones."""
    steps = tuple(range(73))
    rows, names = fitted_paths(t, SPEC, steps, (0.9, 0.95))
    return r6(P.scan_paths(rows, ["series_id", "origin_ts"], names, steps), 4)


# ---- closed forms of iterated, rolled, swapped, selected and yearly readouts ------------------

def _reweighted_sql(kind, tau, steps, h=24):
    """Weighted two-driver ridge, unrolled: even weights first, then weights by the sign (and size) of the residual."""
    weighted = ", ".join(f"sum(w*{e})/sum(w) AS {n}" for n, e in (("m1", "z1"), ("m2", "z2"), ("my", "y"), ("e11", "z1*z1"), ("e22", "z2*z2"), ("e12", "z1*z2"), ("e1", "z1*y"), ("e2", "z2*y")))
    central = "m1, m2, my, e11 - m1*m1 AS v1, e22 - m2*m2 AS v2, e12 - m1*m2 AS c12, e1 - m1*my AS c1, e2 - m2*my AS c2"
    ctes = [f"lb AS (SELECT z1, z2, f.y FROM zz JOIN met f ON f.series_id = zz.series_id AND f.ts = zz.ts + INTERVAL {h} HOUR WHERE zz.split = 'train')", "x0 AS (SELECT *, 1e0 AS w FROM lb)"]
    for k in range(steps + 1):
        ctes.append(f"s{k} AS (SELECT w1, w2, my - w1*m1 - w2*m2 AS w0 FROM (SELECT {W1.format(b='0.5e0')} AS w1, {W2.format(b='0.5e0')} AS w2, m1, m2, my FROM (SELECT {central} FROM (SELECT {weighted} FROM x{k}))))")
        r = "(y - w0 - w1*z1 - w2*z2)"
        size = f"/greatest(abs({r}), 0.001)" if kind == "quantile" else ""
        ctes.append(f"x{k + 1} AS (SELECT z1, z2, y, CASE WHEN {r} > 0 THEN {tau} ELSE {round(1 - tau, 9)} END{size} AS w FROM lb CROSS JOIN s{k})")
    return f"WITH {ZZ}, {', '.join(ctes[:-1])} SELECT {h} AS horizon_h, {R('w1', 5)} AS w1, {R('w2', 5)} AS w2, {R('w0', 5)} AS b0 FROM s{steps}"


def _reweighted(t, kind, tau, steps):
    m = L.fit_reweighted(feats(t, (24,), TWO).where(IS_TRAIN), (24,), (tau,), kind=kind, max_iter=steps, tol=0.0)
    return r6(m.select("horizon_h", F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2"), "b0"), 5)


@query("l3_two_driver_expectile", _reweighted_sql("expectile", 0.9, 4))
def l3b(t):
    """Four reweighted solves in closed form."""
    return _reweighted(t, "expectile", 0.9, 4)


@query("l4_two_driver_quantile", _reweighted_sql("quantile", 0.9, 4))
def l4b(t):
    return _reweighted(t, "quantile", 0.9, 4)


L16_SQL = L14_SQL[: L14_SQL.index("h1 AS (")].rstrip().rstrip(",") + f""", sc AS (SELECT series_id, avg(t_c) AS a1, stddev_pop(t_c) AS d1, avg(rh) AS a2, stddev_pop(rh) AS d2 FROM met WHERE ts < TIMESTAMP '2024-01-11' GROUP BY 1),
    zl AS (SELECT m.series_id, m.ts, (t_c - a1)/d1 AS z1, (rh - a2)/d2 AS z2 FROM met m JOIN sc USING (series_id)),
    ml AS (SELECT series_id, {MOM} FROM (SELECT zl.series_id, z1, z2, f.y FROM zl JOIN met f ON f.series_id = zl.series_id AND f.ts = zl.ts + INTERVAL 2 HOUR WHERE zl.ts < TIMESTAMP '2024-01-11') GROUP BY 1),
    dr AS (SELECT series_id, 'direct' AS kind, {W1.format(b='0.5e0')} AS w1, {W2.format(b='0.5e0')} AS w2, m1, m2, my FROM ml),
    h1 AS (SELECT series_id, w1*k11 + w2*k21 AS u1, w1*k12 + w2*k22 AS u2, my, k11, k12, k21, k22 FROM r JOIN k USING (series_id)),
    al AS (SELECT series_id, kind, w1, w2, my - w1*m1 - w2*m2 AS b0 FROM dr UNION ALL SELECT series_id, 'rollout', u1*k11 + u2*k21, u1*k12 + u2*k22, my FROM h1),
    p AS (SELECT kind, f.y AS y_true, b0 + w1*z1 + w2*z2 AS y_pred FROM zl JOIN al USING (series_id) JOIN met f ON f.series_id = zl.series_id AND f.ts = zl.ts + INTERVAL 2 HOUR WHERE zl.ts >= TIMESTAMP '2024-01-21')
    SELECT kind, 2 AS horizon_h, count(*) AS n, {R('1 - avg(pow(y_pred - y_true, 2))/var_pop(y_true)', 5)} AS r2, {R('sqrt(avg(pow(y_pred - y_true, 2)))', 5)} AS rmse FROM p GROUP BY 1"""


@query("l16_two_driver_rollout", L16_SQL)
def l16b(t):
    """One readout two hours ahead against the same-hour readout rolled twice, per series, on the test part."""
    f = feats(t, (0, 2), TWO, key="series_id").withColumn("model_id", F.col("series_id"))
    tr = f.where(IS_TRAIN)
    roll = L.fit_transition(tr.drop("series_id").withColumnRenamed("model_id", "series_id"), S, (2,)).withColumnRenamed("series_id", "model_id")
    cols = ["model_id", "horizon_h", "kind", "w_raw", "b_raw"]
    both = stage(L.fit_ridge(tr, ["model_id"], (0, 2)).withColumn("kind", F.lit("direct")).select(*cols).unionByName(roll.withColumn("kind", F.lit("rollout")).select(*cols)))
    p = L.score(truth(f, (0, 2)).where("split = 'test' AND horizon_h = 2"), both, ["model_id", "horizon_h"])
    return r6(M.regression_metrics(p, ["kind", "horizon_h"]).select("kind", "horizon_h", "n", "r2", "rmse"), 5)


def _swap_sql(name, a, b):
    return f"""SELECT '{name}' AS variant, * FROM (WITH s AS (SELECT avg({a}) AS mu1, stddev_pop({a}) AS sd1, avg({b}) AS mu2, stddev_pop({b}) AS sd2 FROM met WHERE ts < TIMESTAMP '2024-01-11'),
    lb AS (SELECT CASE WHEN m.ts < TIMESTAMP '2024-01-11' THEN 'train' WHEN m.ts < TIMESTAMP '2024-01-21' THEN 'val' ELSE 'test' END AS split, (m.{a} - mu1)/sd1 AS z1, (m.{b} - mu2)/sd2 AS z2, f.y
      FROM met m CROSS JOIN s JOIN met f ON f.series_id = m.series_id AND f.ts = m.ts + INTERVAL 24 HOUR),
    mo AS (SELECT {MOM} FROM lb WHERE split = 'train'), w AS (SELECT {W1.format(b='0.5e0')} AS w1, {W2.format(b='0.5e0')} AS w2, m1, m2, my FROM mo)
    SELECT 24 AS horizon_h, count(*) AS n, {R('sqrt(avg(pow(my + w1*(z1 - m1) + w2*(z2 - m2) - y, 2)))', 5)} AS rmse, {R('1 - avg(pow(my + w1*(z1 - m1) + w2*(z2 - m2) - y, 2))/var_pop(y)', 5)} AS r2 FROM lb CROSS JOIN w WHERE split = 'test')"""


SWAPS = (("humidity", "t_c", "rh"), ("wind", "t_c", "wind"), ("pressure", "t_c", "p_hpa"))


@query("l18_two_driver_swap", " UNION ALL ".join(_swap_sql(*v) for v in SWAPS))
def l18b(t):
    """One of two drivers exchanged; same rows, same penalty."""
    out = None
    for name, a, b in SWAPS:
        f = feats(t, (24,), X.FeatureSpec(drivers=(a, b), lags=1, windows=(), slow=False, ratio=False))
        p = scored_models(f.where("split = 'test'"), fit(f, (24,)), (24,)).where("y_true IS NOT NULL")
        m = M.regression_metrics(p, ["horizon_h"]).select(F.lit(name).alias("variant"), "horizon_h", "n", "rmse", "r2")
        out = m if out is None else out.unionByName(m)
    return r6(out, 5)


D10_SQL = f"""WITH {TWO_SITE}, {HEADS.replace("split <> 'test'", "split = 'train'")}, it AS (SELECT a.hold, j.src AS gone, a.i, a.v, a.s, sj.s AS at_s FROM lg a JOIN hd j ON j.hold = a.hold AND j.src <> a.src JOIN co sj ON sj.domain = j.src),
    ik AS (SELECT *, exp(-0.5*pow(s - at_s, 2)/var_pop(s) OVER (PARTITION BY hold, gone, i)) AS k FROM it),
    ia AS (SELECT hold, gone, i, avg(v) AS mean, var_pop(v) AS var, regr_slope(v, s) AS slope, avg(s) AS ms, any_value(at_s) AS at_s, sum(k*v)/sum(k) AS near FROM ik GROUP BY 1, 2, 3),
    ir AS (SELECT *, row_number() OVER (PARTITION BY hold, gone ORDER BY var DESC, i) AS r FROM ia),
    ie AS (SELECT hold, gone, i, shrink, CASE WHEN r <= 2 THEN shrink*(mean + slope*(at_s - ms)) + (1 - shrink)*near ELSE mean END AS v FROM ir CROSS JOIN (SELECT unnest([0e0, 0.6e0, 1e0]) AS shrink)),
    iw AS (SELECT hold, gone, shrink, max(CASE WHEN i = 1 THEN v END) AS w1, max(CASE WHEN i = 2 THEN v END) AS w2, max(CASE WHEN i = 3 THEN v END) AS w0 FROM ie GROUP BY 1, 2, 3),
    im AS (SELECT hold, gone, shrink, avg(pow(y - w0 - w1*(x1 - mu1)/sd1 - w2*(x2 - mu2)/sd2, 2)) AS mse FROM iw JOIN fold USING (hold) JOIN rw ON rw.domain = gone WHERE split = 'val' GROUP BY 1, 2, 3),
    ri AS (SELECT hold, shrink, avg(mse) AS risk FROM im GROUP BY 1, 2)
    SELECT hold AS domain, {R('shrink', 4)} AS shrink, {R('risk', 4)} AS inner_risk FROM ri QUALIFY row_number() OVER (PARTITION BY hold ORDER BY risk, shrink) = 1"""


@query("d10_two_driver_selection", D10_SQL)
def d10b(t):
    """Every source left out once more: the shrinkage with the smallest mean risk on the left-out sites."""
    _, models = _two_fit(t, D.TransferSpec(arms=("subspace",), dims=(2,), shrinks=(0.0, 0.6, 1.0)))
    return r6(models.select("domain", "shrink", "inner_risk"), 4)


D15_SQL = f"""WITH dy AS (SELECT date_trunc('day', o_orderdate) AS ts, CAST(count(*) AS DOUBLE) AS x1, sum(o_totalprice)/1e6 AS x2 FROM orders GROUP BY 1),
    lb AS (SELECT year(d.ts) AS domain, d.ts, d.x1, d.x2, f.x1 AS y FROM dy d JOIN dy f ON f.ts = d.ts + INTERVAL 6 DAY AND year(f.ts) = year(d.ts)),
    rw AS (SELECT *, CASE WHEN pos < floor(n_rows*0.6) THEN 'train' WHEN pos < floor(n_rows*0.6) + floor(n_rows*0.2) THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY domain) AS n_rows FROM lb)),
    ds AS (SELECT domain, avg(x1) AS mu1, stddev_pop(x1) AS sd1, avg(x2) AS mu2, stddev_pop(x2) AS sd2 FROM rw WHERE split = 'train' GROUP BY 1),
    fold AS (SELECT h.domain AS hold, count(*) AS n_sources, avg(d.mu1) AS mu1, avg(d.sd1) AS sd1, avg(d.mu2) AS mu2, avg(d.sd2) AS sd2 FROM ds h JOIN ds d ON d.domain <> h.domain GROUP BY 1),
    mo AS (SELECT hold, {MOM} FROM (SELECT hold, (x1 - mu1)/sd1 AS z1, (x2 - mu2)/sd2 AS z2, y FROM fold JOIN rw ON rw.domain <> hold AND split <> 'test') GROUP BY 1),
    w AS (SELECT hold, {W1.format(b='0.5e0')} AS w1, {W2.format(b='0.5e0')} AS w2, m1, m2, my FROM mo),
    pr AS (SELECT hold, n_sources, y, my + w1*((x1 - mu1)/sd1 - m1) + w2*((x2 - mu2)/sd2 - m2) AS p FROM w JOIN fold USING (hold) JOIN rw ON rw.domain = hold AND split = 'test')
    SELECT CAST(hold AS VARCHAR) AS domain, max(n_sources) AS n_sources, count(*) AS n, CASE WHEN count(*) >= 10 THEN {R('1 - avg(pow(p - y, 2))/var_pop(y)', 4)} END AS r2, CASE WHEN count(*) >= 10 THEN {R('sqrt(avg(pow(p - y, 2)))', 4)} END AS rmse FROM pr GROUP BY 1"""


@query("d15_two_driver_years", D15_SQL)
def d15b(t):
    """Years as domains, two drivers, six days ahead: pooled readouts on the mean scale of the other years."""
    daily = t.orders.groupBy(day_floor("o_orderdate").alias("ts")).agg(F.count("*").cast("double").alias("n"), (F.sum("o_totalprice") / 1e6).alias("rev"))
    daily = stage(daily.withColumn("series_id", F.lit("all")))
    f = X.build_features(daily, S, X.FeatureSpec(drivers=("n", "rev"), lags=1, windows=(), slow=False, ratio=False, step=DAY), labels=("n", (6,)))
    f = f.select(F.year("ts").cast("string").alias("domain"), "ts", "psi", F.get("labels", F.lit(0)).alias("y"), F.lit(144).alias("horizon_h"))
    f = f.where((F.year("ts") == F.year(add_hours("ts", "horizon_h"))) & F.col("y").isNotNull())
    z, mom = D.domain_moments(split_by_fraction(f, ["domain", "horizon_h"]).drop("pos", "n_rows"), TASK)
    coords = z.select("domain").distinct().select(F.lit("year").alias("coord"), "domain", F.col("domain").cast("double").alias("s"))
    models = stage(D.fit_domains(mom, coords, TASK, D.TransferSpec(arms=("pooled",), betas=(0.5,), scale="mean_of_domains")))
    s = D.score_domains(D.predict_domains(z, models, TASK), models, TASK)
    return r6(s.select("domain", "n_sources", "n", "r2", "rmse"), 4)


@query("d5_even_risk", _dro_sql().replace("f1 JOIN fold", "f0 JOIN fold").replace("'group_dro'", "'vrex'"))
def d5b(t):
    """Without a penalty on the spread of risks, the minimum of the mean risk: the first step of the reweighting."""
    return _arm_two(t, "vrex", vrex_lambda=0.0)
