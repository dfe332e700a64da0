"""Rankings and set operations (O1-O11), decisions and serving queries."""

from pyspark.sql import functions as F

from ..functions import scores as SC
from ..operators import alarms as A, climate as C, metrics as M, ranking as K
from ..operators.clean import keep_first
from ..operators.features import future_max
from ..operators.joins import attach_cuts, by_label
from ..operators.order import quantiles
from ..session import stage
from .q_features import staged_cuts
from .q_metrics import E2, K3, SLOPES, r2_sql, scored, slopes
from .q_slice import BLOCK_SQL, CUTS_SQL, KEYS, LEAD_SQL, TEST_SQL
from .q_sources import S
from .registry import R, query, r6
from .series import CTES, ts_lit

STEPS = tuple(range(73))
XK = ["series_id", "model", "horizon_h"]

CTES["fcxw"] = CTES["fcw"].replace("unnest([24, 48, 72])", "CAST(unnest(range(0, 73)) AS INT)")
CTES["fcx"] = CTES["fc"].replace("fcw", "fcxw")
CTES["fcxt"] = "SELECT fcx.*, thr.threshold FROM fcx CROSS JOIN (SELECT unnest([62e0, 67e0, 75e0]) AS threshold) thr"
#: Sorted validation values once per (series, model, step); the three cuts are read from them.
XCUTS = "xv AS (SELECT series_id, model, horizon_h, list_sort(list(y_pred)) AS qs, count(*) AS n, " + ", ".join(
    f"(1 - avg(CASE WHEN y_true >= {c} THEN 1e0 ELSE 0e0 END)) * (count(*) - 1) AS p{c}, max(y_true) >= {c} AS e{c}" for c in (62, 67, 75)) + \
    " FROM fcx WHERE split = 'val' AND y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY 1, 2, 3), xcuts AS (SELECT series_id, model, horizon_h, " + ", ".join(
    f"round(CASE WHEN e{c} THEN qs[CAST(floor(p{c}) AS INT) + 1] + (qs[CAST(ceil(p{c}) AS INT) + 1] - qs[CAST(floor(p{c}) AS INT) + 1]) * (p{c} - floor(p{c})) ELSE {c}e0 END, 6) AS cut_{c}" for c in (62, 67, 75)) + \
    """ FROM xv), lev AS (SELECT f.*, cut_62, cut_67, cut_75, CAST(CASE WHEN y_pred >= cut_75 THEN 2 WHEN y_pred >= cut_67 OR y_pred >= cut_62 THEN 1 ELSE 0 END AS BIGINT) AS level,
    CAST(CASE WHEN y_pred >= 75 THEN 2 WHEN y_pred >= 62 THEN 1 ELSE 0 END AS BIGINT) AS level_raw FROM fcx f JOIN xcuts USING (series_id, model, horizon_h) WHERE split = 'test')"""
SCAN = """scan AS (SELECT *, first_true_h - first_alarm_h AS lead_h, CASE WHEN pred_peak >= 62 THEN 1 ELSE 0 END AS crosses FROM (SELECT series_id, model, origin_ts, min(horizon_h) FILTER (y_true >= 62) AS first_true_h,
    min(horizon_h) FILTER (level >= 1) AS first_alarm_h, count(*) FILTER (level >= 1) AS n_alarm, count(*) FILTER (y_true >= 62) AS n_true, max(y_true) AS true_peak, max(y_pred) AS pred_peak FROM lev GROUP BY 1, 2, 3) WHERE n_alarm > 0 AND n_true > 0)"""
CAND = """cand AS (SELECT * REPLACE (CASE WHEN tot = 0 THEN 0 ELSE crosses END AS crosses) FROM (SELECT *, count(*) FILTER (ok) OVER () AS tot FROM (SELECT *, n_alarm >= 6 AND lead_h >= 12 AND n_true >= 6 AS ok FROM scan)) WHERE ok OR tot = 0)"""

BEST = "crosses DESC, n_true DESC, lead_h DESC, true_peak DESC, series_id, model, origin_ts"
SCEN = XCUTS + f""", {SCAN}, {CAND}, pick AS (SELECT CASE rk WHEN 1 THEN 'alarm' ELSE 'demo' END AS scenario, origin_ts FROM (
    SELECT origin_ts, row_number() OVER (ORDER BY best) AS rk FROM (SELECT origin_ts, min(rk) AS best FROM (SELECT origin_ts, row_number() OVER (ORDER BY {BEST}) AS rk FROM cand) GROUP BY 1)) WHERE rk <= 2),
    sc AS (SELECT pick.scenario, lev.* FROM lev JOIN pick USING (origin_ts))"""


def fcx(t):
    return stage(t.fc(STEPS))


def levels(t):
    f = fcx(t)
    return A.with_levels(f.where("split = 'test'"), A.level_cuts(f.where("split = 'val'"), XK), XK).withColumns(
        {c: F.col(c).cast("long") for c in ("level", "level_raw")})


def scenarios(t):
    """All series and readouts at the two origins that the ranking of the scan puts first."""
    lev = stage(levels(t))
    best = A.best_origins(A.demo_candidates(A.scan_origins(lev, ["series_id", "model"])), 2)
    return lev.join(best.select("origin_ts", F.when(F.col("rank") == 1, "alarm").otherwise("demo").alias("scenario")), "origin_ts")


SK = ["scenario", "series_id", "model"]


@query("o1_time_sort", "SELECT event_id, ts FROM events ORDER BY ts, event_id")
def o1(t):
    return t.events.select("event_id", "ts").orderBy("ts", "event_id")


@query("o2_top_weights", f"WITH w AS ({SLOPES}) SELECT name, {R('w')} AS w FROM w ORDER BY abs(w) DESC, name LIMIT 5")
def o2(t):
    return r6(K.top_k(slopes(t), [F.desc(F.abs("w")), "name"], 5))


@query("o3_window_ranking", f"WITH {XCUTS}, {SCAN}, {CAND} SELECT series_id, model, origin_ts, lead_h, n_alarm, n_true, true_peak, pred_peak FROM cand ORDER BY crosses DESC, n_true DESC, lead_h DESC, true_peak DESC, series_id, model, origin_ts LIMIT 10")
def o3(t):
    c = A.demo_candidates(A.scan_origins(levels(t), ["series_id", "model"]))
    return K.top_k(c, A.candidate_order(), 10).select("series_id", "model", "origin_ts", "lead_h", "n_alarm", "n_true", "true_peak", "pred_peak")


@query("o4_nearest_to_quantile", f"""WITH q AS (SELECT series_id, quantile_cont(y, 0.98) AS quantile FROM met GROUP BY 1) SELECT series_id, {R('quantile')} AS quantile, ts, y FROM (
    SELECT m.series_id, q.quantile, m.ts, m.y, row_number() OVER (PARTITION BY m.series_id ORDER BY abs(m.y - q.quantile), m.ts) AS rk FROM met m JOIN q USING (series_id)) WHERE rk = 1""")
def o4(t):
    m = t.met_core()
    target = quantiles(m, S, "y", m.groupBy("series_id").agg(F.lit(0.98).alias("q"))).select("series_id", "quantile")
    return r6(K.nearest_to(m, S, "y", target))


O5 = f"""SELECT series_id, {R('abs(avg(n) - 2)*2/2 + abs(max(n) - min(n) - 5)/5')} AS score FROM sales GROUP BY 1 ORDER BY 2, 1 LIMIT 5"""


@query("o5_best_five", O5)
def o5(t):
    s = C.weighted_error(C.level_summary(t.sales(), S, "n", ()), S, {"mean": (2.0, 2.0), "range": (5.0, 1.0)})
    return K.top_k(r6(s), ["score", "series_id"], 5)


HIST = """SELECT series_id, ts, y FROM (SELECT series_id, ts, y, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n_rows FROM met JOIN (SELECT series_id, max(ts) AS hi FROM met GROUP BY 1) USING (series_id)
    WHERE ts > hi - INTERVAL 240 HOUR) WHERE pos % greatest(1, n_rows // 50) = 0"""


@query("o6_history_decimation", HIST)
def o6(t):
    return K.decimate(K.last_hours(t.met_core(), S, 240), S, 50).select("series_id", "ts", "y")


@query("o7_scenario_union", f"WITH {SCEN} SELECT scenario, series_id, model, horizon_h, y_pred, CASE scenario WHEN 'alarm' THEN 0 ELSE 1 END AS ord FROM sc")
def o7(t):
    s = stage(scenarios(t).select(*SK, "horizon_h", "y_pred"))
    return K.in_order([s.where("scenario = 'alarm'"), s.where("scenario = 'demo'")])


@query("o8_split_union", f"SELECT split, model, horizon_h, {R(f'sqrt(avg({E2}))')} AS rmse FROM fc WHERE split <> 'train' GROUP BY 1, 2, 3")
def o8(t):
    f = stage(t.fc())
    parts = [M.regression_metrics(f.where(F.col("split") == s), ["split", "model", "horizon_h"]).select("split", "model", "horizon_h", "rmse") for s in ("val", "test")]
    return r6(parts[0].unionByName(parts[1]))


@query("o9_distinct_periods", "SELECT round(c_acctbal / 500, 0) + 0e0 AS period, arg_min(c_custkey, c_custkey) AS c_custkey, arg_min(c_acctbal, c_custkey) AS c_acctbal FROM customer GROUP BY 1")
def o9(t):
    c = t.customer.select("c_custkey", "c_acctbal", F.round(F.col("c_acctbal") / 500.0, 0).alias("period"))
    return keep_first(c, ["period"], ["c_custkey"]).select("period", "c_custkey", "c_acctbal")


@query("o10_outlier_split", f"""SELECT series_id, model, horizon_h, {R('r2')} AS r2, abs(r2) >= 0.6 AS excluded FROM (SELECT series_id, model, horizon_h, {r2_sql()} AS r2 FROM fc GROUP BY 1, 2, 3)""")
def o10(t):
    m = stage(M.regression_metrics(t.fc(), K3).select(*K3, "r2"))
    shown = m.where(F.abs("r2") < 0.6).withColumn("excluded", F.lit(False))
    return r6(shown.unionByName(m.where(F.abs("r2") >= 0.6).withColumn("excluded", F.lit(True))))


@query("o11_grid_gains", f"""WITH h AS (SELECT horizon_h, threshold, model, avg(CASE WHEN (y_true >= threshold) = (y_pred >= threshold) THEN 1e0 ELSE 0e0 END) AS hit FROM fct GROUP BY 1, 2, 3)
    SELECT a.horizon_h, a.threshold, {R('b.hit - a.hit')} AS gain FROM h a JOIN h b USING (horizon_h, threshold) WHERE a.model = 'persistence' AND b.model = 'mean24'""")
def o11(t):
    hit = ((F.col("y_true") >= F.col("threshold")) == (F.col("y_pred") >= F.col("threshold"))).cast("double")
    h = t.fct().groupBy("horizon_h", "threshold", "model").agg(F.avg(hit).alias("hit"))
    p = by_label(h, ["horizon_h", "threshold"], "model", ["persistence", "mean24"], "hit")
    return r6(p.select("horizon_h", "threshold", (F.col("mean24") - F.col("persistence")).alias("gain")))


LV = "CASE WHEN {0} >= 75 THEN 2 WHEN {0} >= 67 THEN 1 WHEN {0} >= 62 THEN 1 ELSE 0 END"


@query("a1_raw_level", f"SELECT series_id, ts, {LV.format('y')} AS level FROM met")
def a1(t):
    return t.met_core().select("series_id", "ts", A.raw_level("y").alias("level"))


@query("a2_calibrated_level", f"WITH {XCUTS} SELECT series_id, model, horizon_h, origin_ts, level, level_raw FROM lev")
def a2(t):
    return levels(t).select(*XK, "origin_ts", "level", "level_raw")


@query("a3_quantile_level", "SELECT vec_id, CASE WHEN list_max(members) >= 75 THEN 2 WHEN list_max(members) >= 67 THEN 1 ELSE 0 END AS level FROM ensembles")
def a3(t):
    return t.ensembles().select("vec_id", SC.risk_level("members").alias("level"))


@query("a4_pick_readout", f"""WITH {CUTS_SQL}, v AS (SELECT f.*, cut FROM fct f JOIN cuts USING (series_id, model, horizon_h, threshold) WHERE split = 'val' AND threshold = 62),
    s AS (SELECT series_id, model, 2e0*count(*) FILTER (y_true >= 62 AND y_pred >= cut)/nullif(count(*) FILTER (y_true >= 62) + count(*) FILTER (y_pred >= cut), 0) AS f1 FROM v GROUP BY 1, 2)
    SELECT series_id, model, {R('f1')} AS f1 FROM (SELECT series_id, model, coalesce(f1, 0e0) AS f1, row_number() OVER (PARTITION BY series_id ORDER BY round(coalesce(f1, 0e0), 9) DESC, model) AS rk FROM s) WHERE rk = 1""")
def a4(t):
    f, cuts = staged_cuts(t)
    val = attach_cuts(f.where("split = 'val' AND threshold = 62"), cuts.select(*KEYS, F.round("cut", 6).alias("cut")), KEYS)
    return r6(A.best_readout(val, S))


@query("a5_origin_scan", f"WITH {XCUTS}, {SCAN} SELECT series_id, model, origin_ts, first_true_h, first_alarm_h, lead_h, n_alarm, n_true, true_peak, pred_peak, crosses FROM scan")
def a5(t):
    return A.scan_origins(levels(t), ["series_id", "model"])


@query("a6_forecast_table", f"""WITH {SCEN} SELECT scenario, sc.series_id, horizon_h, valid_ts, max(y_true) AS y_true, max(y_pred) FILTER (model = 'mean24') AS y_mean24, max(y_pred) FILTER (model = 'climatology') AS y_climatology,
    max(level) FILTER (model = 'mean24') AS level, max(cut_62) FILTER (model = 'mean24') AS cut_62, max(m.rh) AS rh_out, max(m.t_c) AS t_out FROM sc LEFT JOIN met m ON m.series_id = sc.series_id AND m.ts = sc.valid_ts GROUP BY 1, 2, 3, 4""")
def a6(t):
    def of(model, c):
        return F.max(F.when(F.col("model") == model, F.col(c)))

    rows = scenarios(t).groupBy("scenario", "series_id", "horizon_h", "valid_ts").agg(
        F.max("y_true").alias("y_true"), of("mean24", "y_pred").alias("y_mean24"), of("climatology", "y_pred").alias("y_climatology"),
        of("mean24", "level").alias("level"), of("mean24", "cut_62").alias("cut_62"))
    obs = t.met().select("series_id", F.col("ts").alias("valid_ts"), F.col("rh").alias("rh_out"), F.col("t_c").alias("t_out"))
    return rows.join(obs, ["series_id", "valid_ts"], "left")


PEAKS = (("event", 0.9999), ("high", 0.98), ("calm", 0.5))
A7 = " UNION ALL ".join(f"SELECT series_id, '{n}' AS label, quantile_cont(future_max, {q}) AS quantile FROM f GROUP BY 1" for n, q in PEAKS)


@query("a7_scenario_selection", f"""WITH f AS (SELECT * FROM (SELECT series_id, ts, max(y) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 72 HOUR FOLLOWING) AS future_max FROM met)
      WHERE ts >= TIMESTAMP '2024-01-21'), q AS ({A7})
    SELECT series_id, label, ts, future_max FROM (SELECT f.series_id, label, ts, future_max, row_number() OVER (PARTITION BY f.series_id, label ORDER BY abs(future_max - quantile), ts) AS rk FROM f JOIN q USING (series_id)) WHERE rk = 1""")
def a7(t):
    f = stage(future_max(t.met_core(), S, "y", 72).where(F.col("ts") >= ts_lit("2024-01-21 00:00:00")).select("series_id", "ts", "future_max"))
    labels = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(q).alias("q")) for n, q in PEAKS]))
    targets = f.select("series_id").distinct().select("series_id", labels.alias("g")).select("series_id", "g.*")
    q = quantiles(f, S, "future_max", targets).select("series_id", "label", "quantile")
    return K.nearest_to(f, S, "future_max", q).select("series_id", "label", "ts", "future_max")


@query("a8_scenario_summary", f"""WITH {SCEN} SELECT scenario, series_id, model, max(y_pred) AS pred_peak, max(y_true) AS true_peak, max(level) AS level, max(level_raw) AS level_raw, count(*) FILTER (level > 0) AS n_warn,
    coalesce(min(horizon_h) FILTER (level > 0), -1) AS first_warn_h FROM sc GROUP BY 1, 2, 3""")
def a8(t):
    return A.scenario_summary(scenarios(t), SK)


@query("a9_forecast_query", f"""WITH {SCEN} SELECT scenario, series_id, model, array_to_string(list(horizon_h ORDER BY horizon_h), ',') AS steps, array_to_string(list(level ORDER BY horizon_h), ',') AS levels, max(level) AS max_level,
    CASE max(level) WHEN 2 THEN 'close' WHEN 1 THEN 'limit visitors' ELSE 'open' END AS advice, max(y_pred) AS peak, CAST(min(horizon_h) FILTER (level >= 1) AS DOUBLE) AS lead_h FROM sc GROUP BY 1, 2, 3""")
def a9(t):
    d = A.forecast_arrays(scenarios(t).withColumn("level", F.col("level").cast("int")), SK)

    def text(c):
        return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")

    return d.select(*SK, text("steps").alias("steps"), text("levels").alias("levels"), F.col("max_level").cast("long").alias("max_level"), "advice", "peak", F.col("lead_h").cast("double").alias("lead_h"))


@query("a10_history_query", """SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M') AS time, t_c, rh, y FROM met WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'""")
def a10(t):
    m = t.met_core().where((F.col("ts") >= ts_lit("2024-01-05 00:00:00")) & (F.col("ts") < ts_lit("2024-01-20 00:00:00")))
    return m.select("series_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"), "t_c", "rh", "y")


@query("a11_comparison_query", f"""WITH {CUTS_SQL}, {TEST_SQL}, {BLOCK_SQL}, ac AS (SELECT model, horizon_h, sqrt(avg({E2})) AS rmse, avg(y_pred-y_true) AS bias FROM fc GROUP BY 1, 2),
    ev AS (SELECT model, horizon_h, count(*) FILTER (y_true >= threshold AND y_pred >= cut) AS tp, count(*) FILTER (y_true >= threshold) AS n_event FROM test GROUP BY 1, 2), du AS (SELECT model, horizon_h, avg(abs(b - a)) AS dur_mae_h FROM blk GROUP BY 1, 2)
    SELECT model, horizon_h, 'accuracy' AS "table", 'rmse' AS metric, {R('rmse')} AS value FROM ac UNION ALL SELECT model, horizon_h, 'accuracy', 'bias', {R('bias')} FROM ac UNION ALL SELECT model, horizon_h, 'events', 'tp', CAST(tp AS DOUBLE) FROM ev
    UNION ALL SELECT model, horizon_h, 'events', 'n_event', CAST(n_event AS DOUBLE) FROM ev UNION ALL SELECT model, horizon_h, 'duration', 'dur_mae_h', {R('dur_mae_h')} FROM du""")
def a11(t):
    """Accuracy, event and duration tables as one long metric table."""
    k = ["model", "horizon_h"]
    test = stage(scored(t))
    ac = A.long_metrics(M.regression_metrics(t.fc(), k), k, ["rmse", "bias"], "accuracy")
    ev = A.long_metrics(M.event_metrics(test, k), k, ["tp", "n_event"], "events")
    du = A.long_metrics(M.plain_duration_error(M.block_hours(test, KEYS), k), k, ["dur_mae_h"], "duration")
    return r6(ac.unionByName(ev).unionByName(du))


@query("a12_ablation_validation", f"WITH s AS ({O5}) SELECT 'calibration' AS part, CAST(series_id AS VARCHAR) AS item, score AS value FROM s UNION ALL SELECT 'ablation', model, {R(f'sqrt(avg({E2}))')} FROM fc WHERE split = 'test' GROUP BY 2")
def a12(t):
    best = o5(t).select(F.lit("calibration").alias("part"), F.col("series_id").cast("string").alias("item"), F.col("score").alias("value"))
    abl = M.regression_metrics(t.fc().where("split = 'test'"), ["model"]).select(F.lit("ablation").alias("part"), F.col("model").alias("item"), F.col("rmse").alias("value"))
    return r6(best.unionByName(abl))


@query("a13_timeline", f"""WITH {SCEN}, f AS (SELECT scenario, series_id, model, CAST(min(horizon_h) FILTER (level >= 1) AS DOUBLE) AS first_alarm_h, CAST(min(horizon_h) FILTER (y_true >= 62) AS DOUBLE) AS first_event_h FROM sc GROUP BY 1, 2, 3)
    SELECT scenario, series_id, model, horizon_h, y_true >= 62 AS over, level >= 1 AS alarm, first_alarm_h, first_event_h, first_event_h - first_alarm_h AS lead_h FROM sc JOIN f USING (scenario, series_id, model)""")
def a13(t):
    d = A.timeline(stage(scenarios(t)), SK)
    return d.withColumns({c: F.col(c).cast("double") for c in ("first_alarm_h", "first_event_h", "lead_h")})


@query("a14_history_extract", f"SELECT series_id, ts, {R('t_c', 1)} AS t_c, {R('y', 1)} AS y FROM met WHERE ts >= TIMESTAMP '2024-01-15'")
def a14(t):
    m = t.met_core().where(F.col("ts") >= ts_lit("2024-01-15 00:00:00"))
    return m.select("series_id", "ts", F.round("t_c", 1).alias("t_c"), F.round("y", 1).alias("y"))


@query("a15_kpi_extract", f"""WITH {CUTS_SQL}, {TEST_SQL}, {LEAD_SQL} SELECT series_id, count(lead_h) || '/' || count(*) AS hits, printf('%.1f', avg(lead_h)) AS mean_lead FROM leads WHERE model = 'mean24' AND horizon_h = 24 AND threshold = 62 GROUP BY 1""")
def a15(t):
    """One (model, horizon, threshold) cell as display text."""
    f = stage(t.fct((24,)).where("model = 'mean24' AND threshold = 62"))
    cuts = M.calibrate_cuts(f.where("split = 'val'"), KEYS).select(*KEYS, F.round("cut", 6).alias("cut"))
    le = M.lead_time(f.where("split = 'test'").join(cuts, KEYS), KEYS).where("n_onset > 0")
    return le.select("series_id", F.concat_ws("/", F.col("n_warned").cast("string"), F.col("n_onset").cast("string")).alias("hits"), F.format_string("%.1f", "mean_lead_h").alias("mean_lead"))


@query("a16_scenario_metadata", f"""WITH {SCEN} SELECT scenario, series_id, count(*) FILTER (model = 'mean24' AND y_true >= 62) AS true_hours, count(*) FILTER (model = 'mean24' AND y_pred >= 62) AS mean24_hours,
    count(*) FILTER (model = 'climatology' AND y_pred >= 62) AS climatology_hours, count(*) FILTER (model = 'mean24' AND level >= 1) AS alarm_hours FROM sc GROUP BY 1, 2""")
def a16(t):
    m, c = F.col("model") == "mean24", F.col("model") == "climatology"
    over = F.col("y_pred") >= A.WARN
    return scenarios(t).groupBy("scenario", "series_id").agg(
        F.count_if(m & (F.col("y_true") >= A.WARN)).alias("true_hours"), F.count_if(m & over).alias("mean24_hours"),
        F.count_if(c & over).alias("climatology_hours"), F.count_if(m & (F.col("level") >= 1)).alias("alarm_hours"))
