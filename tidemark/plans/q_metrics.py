"""Aggregations and metrics."""

from pyspark.sql import functions as F

from ..functions import scores as SC
from ..functions.calendar import day_floor
from ..operators import climate as C, metrics as M
from ..operators.chunks import windowed
from ..operators.features import moving_means
from ..operators.joins import by_label, with_grid
from ..operators.order import fixed_quantiles
from ..session import stage
from .q_features import staged_cuts
from .q_slice import BLOCK_SQL, CUTS_SQL, KEYS, LEAD_SQL, TEST_SQL
from .q_sources import S
from .registry import R, query, r6
from .series import THRESHOLDS, split_of, ts_lit

K3 = ["series_id", "model", "horizon_h"]
E2 = "(y_pred-y_true)*(y_pred-y_true)"
K4S = "series_id, model, horizon_h, threshold"


def r2_sql(mse=f"avg({E2})", var="var_pop(y_true)"):
    return f"CASE WHEN {var} > 0 THEN 1 - {mse}/{var} END"


def scored(t):
    f, cuts = staged_cuts(t)
    return f.where("split = 'test'").join(cuts.select(*KEYS, F.round("cut", 6).alias("cut")), KEYS)


@query("m1_regression", f"""SELECT series_id, model, horizon_h, count(*) AS n, {R(f'sqrt(avg({E2}))')} AS rmse, {R('avg(abs(y_pred-y_true))')} AS mae,
    {R(r2_sql())} AS r2, {R('avg(y_pred-y_true)')} AS bias FROM fc GROUP BY 1, 2, 3""")
def m1(t):
    return r6(M.regression_metrics(t.fc(), K3).select(*K3, "n", "rmse", "mae", "r2", "bias"))


@query("m2_guarded_score", f"""SELECT series_id, model, horizon_h, day, n, CASE WHEN n >= 10 THEN {R('CASE WHEN v > 0 THEN 1 - e/v END', 4)} END AS r2, CASE WHEN n >= 10 THEN {R('sqrt(e)')} END AS rmse,
    CASE WHEN n >= 10 THEN {R('CASE WHEN v > 0 THEN sqrt(e)/sqrt(v) END')} END AS nrmse FROM (SELECT series_id, model, horizon_h, date_trunc('day', origin_ts) AS day, count(*) AS n, avg({E2}) AS e, var_pop(y_true) AS v FROM fc GROUP BY 1, 2, 3, 4)""")
def m2(t):
    d = t.fc().withColumn("day", day_floor("origin_ts"))
    m = M.regression_metrics(d, [*K3, "day"], min_pairs=10)
    return r6(m.select(*K3, "day", "n", F.round("r2", 4).alias("r2"), "rmse", "nrmse"))


EV = f"""SELECT {K4S}, count(*) AS n, count(*) FILTER (y_true >= threshold) AS n_event, count(*) FILTER (y_true >= threshold AND y_pred >= cut) AS tp,
    count(*) FILTER (y_true < threshold AND y_pred >= cut) AS fp, count(*) FILTER (y_true >= threshold AND y_pred < cut) AS fn FROM test GROUP BY ALL"""


@query("m3_event_detection", f"""WITH {CUTS_SQL}, {TEST_SQL}, ev AS ({EV}) SELECT *, {R('n_event/n')} AS base_rate, {R('(tp+fp)/n')} AS alarm_rate,
    {R('CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0e0 END')} AS precision, {R('CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0e0 END')} AS recall,
    {R('CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn) ELSE 0e0 END')} AS f1 FROM ev""")
def m3(t):
    return r6(M.event_metrics(scored(t), KEYS))


AUC_SQL = f"""SELECT {K4S}, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN {R('(rp - n_pos*(n_pos+1)/2e0)/(CAST(n_pos AS DOUBLE)*n_neg)')} END AS auc FROM (
    SELECT {K4S}, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(1-p) AS BIGINT) AS n_neg, sum(p*rk) AS rp FROM (
      SELECT {K4S}, CASE WHEN y_true >= threshold THEN 1 ELSE 0 END AS p, rank() OVER (PARTITION BY {K4S} ORDER BY y_pred) + (count(*) OVER (PARTITION BY {K4S}, y_pred) - 1)/2e0 AS rk
      FROM fct) GROUP BY ALL)"""


@query("m4_auc", AUC_SQL)
def m4(t):
    """Exact AUC: distinct scores only are ordered, over range partitions."""
    return r6(M.exact_auc(t.fct(), KEYS, F.col("y_true") >= F.col("threshold")))


@query("m5_calibrate_cut", f"WITH {CUTS_SQL} SELECT {K4S}, {R('br')} AS base_rate, cut FROM cuts")
def m5(t):
    return r6(M.calibrate_cuts(t.fct().where("split = 'val'"), KEYS))


DUR_SQL = f"""SELECT {K4S}, count(*) AS n_window, count(*) FILTER (a > 0) AS n_event_window, {R('CASE WHEN count(*) FILTER (a > 0) > 0 THEN count(*) FILTER (a > 0 AND b > 0)/count(*) FILTER (a > 0) END')} AS hit_window,
    {R('avg(CASE WHEN a > 0 AND b > 0 THEN abs(b-a) END)')} AS cond_dur_mae_h, {R('avg(CASE WHEN a > 0 AND b > 0 THEN abs(b-a) WHEN a > 0 THEN a WHEN b > 0 THEN b END)')} AS joint_dur_mae_h,
    {R('coalesce(avg(CASE WHEN a = 0 AND b > 0 THEN b END), 0)')} AS false_alarm_h, {R('avg(CASE WHEN a > 0 THEN b - a END)')} AS dur_bias_h FROM blk GROUP BY ALL"""


@query("m6_duration", f"WITH {CUTS_SQL}, {TEST_SQL}, {BLOCK_SQL} {DUR_SQL}")
def m6(t):
    return r6(M.duration_metrics(M.block_hours(scored(t), KEYS), KEYS))


@query("m7_lead_time", f"""WITH {CUTS_SQL}, {TEST_SQL}, {LEAD_SQL}, g AS (SELECT {K4S}, count(*) AS n_onset, count(lead_h) AS n_warned, avg(lead_h) AS ml FROM leads GROUP BY ALL)
    SELECT k.*, coalesce(n_onset, 0) AS n_onset, coalesce(n_warned, 0) AS n_warned, {R('n_warned/n_onset')} AS detect_rate, {R('ml')} AS mean_lead_h
    FROM (SELECT DISTINCT {K4S} FROM test) k LEFT JOIN g USING ({K4S})""")
def m7(t):
    return r6(M.lead_time(scored(t), KEYS))


K3T = ["series_id", "model", "threshold"]


@query("m7_issue_time_lead", f"""WITH {CUTS_SQL}, {TEST_SQL}, hr AS (SELECT series_id, model, threshold, valid_ts, bool_or(y_true >= threshold) AS a, max(horizon_h) FILTER (y_pred >= cut) AS lead
      FROM test WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY ALL),
    ons AS (SELECT h.*, p.a AS prev FROM hr h LEFT JOIN hr p ON p.series_id = h.series_id AND p.model = h.model AND p.threshold = h.threshold AND p.valid_ts = h.valid_ts - INTERVAL 1 HOUR WHERE h.a AND NOT coalesce(p.a, false))
    SELECT series_id, model, threshold, count(*) AS n_onset, count(lead) AS n_warned, {R('avg(lead)')} AS mean_issue_lead_h FROM ons GROUP BY 1, 2, 3""")
def m7_issue(t):
    """How early the forecast that alarms at the onset was issued, beside the valid-time lead."""
    return r6(M.issue_time_lead(scored(t), K3T))


@query("m8_peak_capture", f"""WITH q AS (SELECT series_id, model, horizon_h, quantile_cont(y_true, 0.99) AS q FROM fc GROUP BY 1, 2, 3)
    SELECT series_id, model, horizon_h, count(*) AS peak_n, {R('avg(y_true)')} AS peak_true, {R('avg(y_pred)')} AS peak_pred, {R('avg(y_pred)/avg(y_true)')} AS peak_ratio
    FROM fc JOIN q USING (series_id, model, horizon_h) WHERE y_true >= q GROUP BY 1, 2, 3""")
def m8(t):
    return r6(M.peak_capture(t.fc(), K3))


@query("m9_plain_duration", f"""WITH {CUTS_SQL}, {TEST_SQL}, {BLOCK_SQL} SELECT {K4S}, {R('avg(abs(b-a))')} AS dur_mae_h, {R('avg(b-a)')} AS dur_bias_h, {R('sqrt(avg((b-a)*(b-a)))')} AS dur_rmse_h FROM blk GROUP BY ALL""")
def m9(t):
    return r6(M.plain_duration_error(M.block_hours(scored(t), KEYS), KEYS))


@query("m10_event_blocks", f"""WITH {CUTS_SQL}, {TEST_SQL}, {BLOCK_SQL} SELECT {K4S}, count(*) FILTER (a > 0) AS n_event_block, {R('coalesce(avg(CASE WHEN a > 0 THEN CASE WHEN b > 0 THEN 1e0 ELSE 0e0 END END), 0)')} AS hit_window,
    {R('coalesce(avg(CASE WHEN a = 0 THEN CASE WHEN b > 0 THEN 1e0 ELSE 0e0 END END), 0)')} AS false_window, {R('avg(CASE WHEN a > 0 THEN abs(b-a) END)')} AS cond_dur_mae_h FROM blk GROUP BY ALL""")
def m10(t):
    return r6(M.event_block_metrics(M.block_hours(scored(t), KEYS), KEYS))


@query("m11_evaluation", f"""SELECT series_id, model, horizon_h, {R(f'sqrt(avg({E2}))')} AS rmse, {R(r2_sql())} AS r2, {R('avg(CASE WHEN y_true >= 62 THEN 1e0 ELSE 0e0 END)')} AS base_rate,
    {R('avg(CASE WHEN y_pred >= 62 THEN 1e0 ELSE 0e0 END)')} AS pred_rate, {R('quantile_cont(y_pred, 0.95)')} AS pred_p95, max(y_pred) AS pred_max FROM fc GROUP BY 1, 2, 3""")
def m11(t):
    f = t.fc()
    reg = M.regression_metrics(f, K3).select(*K3, "rmse", "r2")
    ev = M.event_metrics(with_grid(f, threshold=[62.0]).withColumn("cut", F.lit(62.0)), K3).select(*K3, "base_rate", F.col("alarm_rate").alias("pred_rate"))
    top = f.groupBy(*K3).agg(F.max("y_pred").alias("pred_max"))
    return r6(reg.join(ev, K3).join(top, K3).join(fixed_quantiles(f, K3, "y_pred", {"pred_p95": 0.95}), K3))


TAU64 = tuple(i / 65 for i in range(1, 65))


@query("m12_weighted_quantile_score", f"""SELECT y, count(*)//64 AS n, {R('avg((1e0 + 1.5e0*(1e0/(1e0+exp(-(y-67e0)/2e0)))*greatest(2e0*tau-1e0,0e0)*exp(-24/48e0))*greatest(tau*(y-q),(tau-1e0)*(y-q)))')} AS score
    FROM (SELECT vec_id, y, unnest(list_transform(range(1, 65), lambda i: i/65e0)) AS tau, unnest(list_sort(members)) AS q FROM ensembles) GROUP BY 1""")
def m12(t):
    e = t.ensembles().select("y", SC.non_crossing("members").alias("q"))
    w = SC.tail_weights("y", F.lit(24), TAU64, gamma=1.5)
    return r6(e.groupBy("y").agg(F.count("*").alias("n"), F.avg(SC.weighted_quantile_loss("q", "y", TAU64, w)).alias("score")))


@query("m13_threshold_crps", f"""WITH x AS (SELECT vec_id, greatest(y, 52e0) AS y, unnest(members) AS m FROM ensembles), r AS (SELECT vec_id, y, greatest(m, 52e0) AS m,
    row_number() OVER (PARTITION BY vec_id ORDER BY m) AS i, count(*) OVER (PARTITION BY vec_id) AS n FROM x)
    SELECT vec_id, {R('avg(abs(m - y)) - sum((2*i - n - 1)*m)/(max(n)*max(n))', 4)} AS tw_crps FROM r GROUP BY vec_id""")
def m13(t):
    return r6(t.ensembles().select("vec_id", SC.threshold_crps("members", "y", 52.0).alias("tw_crps")), 4)


@query("m14_two_source_agreement", f"""WITH o AS (SELECT date_trunc('day', o_orderdate) AS ts, count(*) AS a FROM orders GROUP BY 1), s AS (SELECT date_trunc('day', l_shipdate) AS ts, count(*)/4e0 AS b FROM lineitem GROUP BY 1)
    SELECT year(ts) AS year, count(*) AS n, {R('corr(a, b)')} AS r, {R('avg(b - a)')} AS bias, {R('sqrt(avg((b-a)*(b-a)))')} AS rmse, {R('avg(abs(b-a))')} AS mae FROM o JOIN s USING (ts) GROUP BY 1 HAVING count(*) >= 10""")
def m14(t):
    o = t.orders.groupBy(day_floor("o_orderdate").alias("ts")).agg(F.count("*").alias("a"))
    s = t.lineitem.groupBy(day_floor("l_shipdate").alias("ts")).agg((F.count("*") / 4.0).alias("b"))
    j = o.join(s, "ts").withColumn("year", F.year("ts").cast("long"))
    return r6(M.agreement(j, ["year"]))


HARM = """SELECT series_id, zone, n, mean, sqrt(ca*ca + sb*sb) AS amplitude, (atan2(sb, ca)*24/(2*pi()) + 24) % 24 AS peak_h FROM (
    SELECT *, (yc*ss - ys*cs)/(cc*ss - cs*cs) AS ca, (ys*cc - yc*cs)/(cc*ss - cs*cs) AS sb FROM (
    SELECT series_id, zone, count(*) AS n, avg(v) AS mean, var_pop(c) AS cc, var_pop(s) AS ss, covar_pop(c, s) AS cs, covar_pop(v, c) AS yc, covar_pop(v, s) AS ys FROM (
    SELECT *, cos(2*pi()*hour(ts)/24) AS c, sin(2*pi()*hour(ts)/24) AS s FROM (SELECT series_id, ts, 'rh' AS zone, rh AS v FROM met UNION ALL SELECT series_id, ts, 'y' AS zone, y AS v FROM met)) GROUP BY 1, 2)) WHERE n >= 50"""


def zones(t):
    return t.met().select("series_id", "ts", "rh", "y").unpivot(["series_id", "ts"], ["rh", "y"], "zone", "v")


@query("m15_harmonic_fit", f"SELECT series_id, zone, n, {R('mean')} AS mean, {R('amplitude')} AS amplitude, {R('peak_h')} AS peak_h FROM ({HARM})")
def m15(t):
    return r6(C.harmonic_fit(zones(t), ["series_id", "zone"], "v", 24.0))


@query("m16_damping", f"""WITH h AS ({HARM}) SELECT o.series_id, {R('o.amplitude')} AS amp_outer, {R('i.amplitude')} AS amp_inner, {R('i.amplitude/o.amplitude')} AS amp_ratio,
    CASE WHEN o.amplitude > 0.05 AND i.amplitude > 0.05 THEN {R('((i.peak_h - o.peak_h + 24) % 24)*60')} END AS lag_min FROM h o JOIN h i USING (series_id) WHERE o.zone = 'rh' AND i.zone = 'y'""")
def m16(t):
    return r6(C.damping(C.harmonic_fit(zones(t), ["series_id", "zone"], "v", 24.0), S, "zone", "rh", "y"))


RANGE = """SELECT series_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, max(y) - min(y) AS i, max(rh) - min(rh) AS o, (max(wind) + min(wind))/2 AS mid FROM met GROUP BY 1, 2"""


@query("m17_daily_range_ratio", f"""WITH d AS ({RANGE}), op AS (SELECT m.series_id, d.day, avg(CASE WHEN wind > mid THEN 1e0 ELSE 0e0 END) > 0.5 AS is_open FROM met m JOIN d ON d.series_id = m.series_id AND d.day = CAST(m.ts + INTERVAL 8 HOUR AS DATE) GROUP BY 1, 2)
    SELECT 'all' AS days, series_id, count(*) AS n_days, {R('median(i/o)')} AS range_ratio FROM d WHERE o > 0.5 GROUP BY 2 HAVING count(*) >= 10
    UNION ALL SELECT CASE WHEN is_open THEN 'open' ELSE 'closed' END, series_id, count(*), {R('median(i/o)')} FROM d JOIN op USING (series_id, day) WHERE o > 0.5 GROUP BY 1, 2 HAVING count(*) >= 10""")
def m17(t):
    m = t.met()
    out = C.daily_range_ratio(m, S, "y", "rh", "Asia/Shanghai").withColumn("days", F.lit("all"))
    for label, flag in (("open", True), ("closed", False)):
        out = out.unionByName(C.daily_range_ratio(m, S, "y", "rh", "Asia/Shanghai", flow="wind", open_days=flag).withColumn("days", F.lit(label)))
    return r6(out)


@query("m18_residual_std", f"SELECT series_id, {R('sqrt(sum((n - m)*(n - m))/(count(*) - 1))')} AS residual_std FROM (SELECT series_id, n, avg(n) OVER (PARTITION BY series_id, year(ts), month(ts)) AS m FROM sales) GROUP BY 1")
def m18(t):
    return r6(C.residual_std(t.sales(), S, "n"))


@query("m19_level_summary", f"""SELECT series_id, count(y) AS n, {R('avg(y)')} AS mean, min(y) AS min, max(y) AS max, {R('max(y) - min(y)')} AS range, {R('stddev_samp(y)')} AS std,
    {', '.join(f"{R(f'avg(CASE WHEN y > {int(x)} THEN 1e0 ELSE 0e0 END)')} AS share_gt_{int(x)}" for x in THRESHOLDS)}, {R('quantile_cont(y, 0.95)')} AS p95 FROM met GROUP BY 1""")
def m19(t):
    m = t.met_core()
    return r6(C.level_summary(m, S, "y", THRESHOLDS).join(fixed_quantiles(m, S, "y", {"p95": 0.95}), S))


@query("m20_daily_peak_gain", f"SELECT series_id, {R('avg(o - b)')} AS peak_gain FROM (SELECT series_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS d, max(y) AS b, max(rh) AS o FROM met GROUP BY 1, 2) GROUP BY 1")
def m20(t):
    return r6(C.daily_peak_gain(zones(t), S, "zone", "v", "y", "rh", "Asia/Shanghai"))


@query("m21_weighted_error", f"""SELECT series_id, {R('abs(avg(y) - 50)*2/50 + abs(max(y) - min(y) - 80)*1.5/80 + abs(stddev_samp(y) - 12)/12')} AS score FROM met GROUP BY 1""")
def m21(t):
    return r6(C.weighted_error(C.level_summary(t.met_core(), S, "y", ()), S, {"mean": (50.0, 2.0), "range": (80.0, 1.5), "std": (12.0, 1.0)}))


def month_sql(col):
    return f"""SELECT series_id, min(m) AS lo, max(m) AS hi, arg_min(mo, m*1e8 + mo) AS month_min, arg_min(mo, -m*1e8 + mo) AS month_max FROM (
        SELECT series_id, month(ts) AS mo, round(avg({col}), 6) AS m FROM sales GROUP BY 1, 2) GROUP BY 1"""


@query("m22_monthly_climatology", f"""WITH a AS ({month_sql('n')}), b AS ({month_sql('cents/1e8')}) SELECT series_id, {R('a.lo')} AS lo, {R('a.hi')} AS hi, a.month_min, a.month_max,
    (b.month_min - a.month_min + 12) % 12 AS lag_months FROM a JOIN b USING (series_id)""")
def m22(t):
    s = t.sales()
    a = C.monthly_climatology(s, S, "n")
    b = C.monthly_climatology(s.withColumn("c", F.col("cents") / 1e8), S, "c").select("series_id", F.col("month_min").alias("_b"))
    out = a.join(b, S).select("series_id", "lo", "hi", "month_min", "month_max", F.pmod(F.col("_b") - F.col("month_min"), F.lit(12)).alias("lag_months"))
    return r6(out.withColumns({c: F.col(c).cast("long") for c in ("month_min", "month_max", "lag_months")}))


def circ_sql(col):
    return f"""SELECT series_id, (atan2(avg(sin(h*2*pi()/24)), avg(cos(h*2*pi()/24)))*24/(2*pi()) + 24) % 24 AS c FROM (
        SELECT series_id, d, hour(ts) + minute(ts)/60 AS h FROM (SELECT series_id, CAST(ts AS DATE) AS d, ts, row_number() OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY {col} DESC, ts) AS rk FROM met) WHERE rk = 1) GROUP BY 1"""


@query("m23_circular_lag", f"""WITH o AS ({circ_sql('rh')}), i AS ({circ_sql('y')}) SELECT series_id, {R('o.c')} AS hour_outside, {R('i.c')} AS hour_inside,
    {R('((i.c - o.c)*60 + 720 + 1440) % 1440 - 720')} AS lag_min FROM o JOIN i USING (series_id)""")
def m23(t):
    return r6(C.daily_lag(t.met_core(), S, "y", "rh", "max"))


@query("m24_acceptance", f"""WITH a AS ({month_sql('n')}), r AS (SELECT avg(lo) AS ref_lo, avg(hi) AS ref_hi FROM a) SELECT series_id, {R('lo')} AS model_lo, {R('hi')} AS model_hi, {R('ref_lo')} AS ref_lo, {R('ref_hi')} AS ref_hi,
    abs(lo - ref_lo) <= greatest(0.35*abs(ref_lo), 0.3) AND abs(hi - ref_hi) <= greatest(0.35*abs(ref_hi), 0.3) AS accepted FROM a CROSS JOIN r""")
def m24(t):
    a = C.monthly_climatology(t.sales(), S, "n").select("series_id", F.col("lo").alias("model_lo"), F.col("hi").alias("model_hi"))
    a = stage(a)
    return r6(C.acceptance(a.withColumns({f"ref_{k}": a.agg(F.avg(f"model_{k}")).scalar() for k in ("lo", "hi")}), floor=0.3))


FOLD = f"SELECT series_id, model, horizon_h, sqrt(avg({E2})) AS rmse, {r2_sql()} AS r2, sqrt(avg({E2}))/stddev_pop(y_true) AS nrmse FROM fc GROUP BY 1, 2, 3"


@query("m25_fold_summary", f"""WITH f AS ({FOLD}), b AS (SELECT series_id, horizon_h, rmse AS base FROM f WHERE model = 'persistence') SELECT model, horizon_h, count(*) AS folds, {R('median(r2)')} AS median_r2, {R('avg(r2)')} AS mean_r2,
    count(*) FILTER (r2 > 0) AS n_r2_pos, count(*) FILTER (nrmse < 1) AS n_nrmse_ok, count(*) FILTER (rmse < base) AS wins FROM f JOIN b USING (series_id, horizon_h) GROUP BY 1, 2""")
def m25(t):
    """Folds are sites: the exact median runs over one row per site."""
    return r6(fold_summary(M.regression_metrics(t.fc(), K3), "persistence"))


def fold_summary(folds, baseline):
    base = folds.where(F.col("model") == baseline).select("series_id", "horizon_h", F.col("rmse").alias("_base"))
    return folds.join(base, ["series_id", "horizon_h"]).groupBy("model", "horizon_h").agg(
        F.count("*").alias("folds"), F.median("r2").alias("median_r2"), F.avg("r2").alias("mean_r2"), F.count_if(F.col("r2") > 0).alias("n_r2_pos"),
        F.count_if(F.col("nrmse") < 1).alias("n_nrmse_ok"), F.count_if(F.col("rmse") < F.col("_base")).alias("wins"))


@query("m26_pivot_report", "SELECT model, threshold, " + ", ".join(f"{R(f'avg(CASE WHEN horizon_h = {h} THEN hit END)')} AS h{h}" for h in (24, 48, 72)) +
       " FROM (SELECT *, CASE WHEN (y_true >= threshold) = (y_pred >= threshold) THEN 1e0 ELSE 0e0 END AS hit FROM fct) GROUP BY 1, 2")
def m26(t):
    hit = ((F.col("y_true") >= F.col("threshold")) == (F.col("y_pred") >= F.col("threshold"))).cast("double")
    p = t.fct().groupBy("model", "threshold").pivot("horizon_h", [24, 48, 72]).agg(F.avg(hit))
    return r6(p.select("model", "threshold", *[F.col(str(h)).alias(f"h{h}") for h in (24, 48, 72)]))


@query("m27_daily_resample", f"SELECT series_id, date_trunc('day', ts) AS day, {R('avg(y)')} AS mean_y, max(y) AS max_y FROM met GROUP BY 1, 2")
def m27(t):
    return r6(t.met_core().groupBy("series_id", day_floor("ts").alias("day")).agg(F.avg("y").alias("mean_y"), F.max("y").alias("max_y")))


@query("m28_ablation_deltas", f"""WITH s AS (SELECT split, horizon_h, model, sqrt(avg({E2})) AS rmse, avg(abs(y_pred-y_true)) AS mae FROM fc WHERE split <> 'train' GROUP BY 1, 2, 3)
    SELECT s.split, s.horizon_h, s.model, {R('s.rmse')} AS rmse, {R('s.mae')} AS mae, {R('s.rmse - f.rmse')} AS d_rmse, {R('s.mae - f.mae')} AS d_mae FROM s JOIN s f ON f.split = s.split AND f.horizon_h = s.horizon_h AND f.model = 'mean24'""")
def m28(t):
    k = ["split", "horizon_h"]
    s = M.regression_metrics(t.fc().where("split <> 'train'"), [*k, "model"])
    return r6(M.deltas_to(s, k, "model", "mean24", ["rmse", "mae"]))


SLOPES = " UNION ALL ".join(
    [f"SELECT '{d}_lag{k}' AS name, regr_slope(m.y, b.{d}) AS w FROM met m JOIN met b ON b.series_id = m.series_id AND b.ts = m.ts - INTERVAL {k} HOUR"
     for d in ("rh", "t_c") for k in range(4)] +
    [f"SELECT '{d}_ma24' AS name, regr_slope(y, v) AS w FROM (SELECT y, avg({d}) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS v FROM met)" for d in ("rh", "t_c")])
SLOPES = f"SELECT name, round(w, 9) AS w FROM ({SLOPES})"


def slopes(t):
    """Named weights: slope of the target on each lag or slow feature."""
    names = [f"{d}_lag{k}" for d in ("rh", "t_c") for k in range(4)] + ["rh_ma24", "t_c_ma24"]

    def make(f):
        cols = {f"{d}_lag{k}": f.at(d, -k) for d in ("rh", "t_c") for k in range(4)}
        return cols | {f"{d}_ma24": moving_means(f, d, 24) for d in ("rh", "t_c")}

    wide = windowed(t.met_core(), S, make, back=24)
    long = wide.unpivot(["series_id", "ts", "y"], names, "name", "v")
    return long.groupBy("name").agg(F.round(F.regr_slope("y", "v"), 9).alias("w"))


FAMILY = "CASE WHEN starts_with(name, 'ratio') THEN 'ratio' WHEN contains(name, '_ma') THEN 'slow_ma' ELSE 'fast_lag' END"


@query("m29_family_importance", f"""WITH w AS ({SLOPES}), g AS (SELECT {FAMILY} AS family, sum(abs(w)) AS total, avg(abs(w)) AS mean, count(*) AS n FROM w GROUP BY 1)
    SELECT family, {R('total')} AS total, {R('mean')} AS mean, n, {R('total/sum(total) OVER ()', 4)} AS share FROM g""")
def m29(t):
    from ..operators.linear import family_importance

    return r6(family_importance(slopes(t)))


@query("m30_climatology", f"SELECT series_id, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, {R('avg(y)')} AS clim FROM met WHERE ts < TIMESTAMP '2024-01-11' GROUP BY 1, 2, 3, 4")
def m30(t):
    c = C.climatology(t.met_core().where(F.col("ts") < ts_lit("2024-01-11 00:00:00")), S, "y")
    return r6(c.withColumns({k: F.col(k).cast("long") for k in ("month", "day", "hour")}))


@query("m31_linear_relation", f"SELECT l_returnflag, {R('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {R('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept, {R('corr(l_extendedprice, l_quantity)')} AS r FROM lineitem GROUP BY 1")
def m31(t):
    d = C.linear_relation(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return d.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 6).alias("r"))


@query("m32_degeneracy", f"""SELECT series_id, model, horizon_h, min(y_pred) AS min, max(y_pred) AS max, {R('avg(y_pred)')} AS mean, {R('stddev_pop(y_pred)')} AS std, {R('avg(CASE WHEN y_pred <= 40 THEN 1e0 ELSE 0e0 END)')} AS share_lo,
    {R('avg(CASE WHEN y_pred >= 60 THEN 1e0 ELSE 0e0 END)')} AS share_hi, count(DISTINCT round(y_pred, 6)) AS n_distinct FROM fc GROUP BY 1, 2, 3""")
def m32(t):
    return r6(M.degeneracy(t.fc(), K3, lo=40.0, hi=60.0))
