"""Window features (W1-W15) and joins."""

from pyspark.sql import functions as F

from ..functions.calendar import DAY, add_hours
from ..operators import features as X, joins as J
from ..operators.chunks import windowed
from ..operators.clean import domain_guards, dropped_domains, kept_domains
from ..operators.metrics import calibrate_cuts, onset_leads, regression_metrics
from ..session import stage
from .q_slice import CUTS_SQL, KEYS, LEAD_SQL, TEST_SQL
from .q_sources import S
from .registry import R, query, r6
from .series import THRESHOLDS, split_of, ts_lit


def vector_rows(df, keys=("series_id", "ts")):
    return r6(df.select(*keys, F.posexplode("psi").alias("pos", "v")).withColumn("pos", F.col("pos").cast("long")))


def lag_sql(drivers, lags):
    """(series_id, ts, pos, v) of full lag windows, lag-major."""
    parts = " UNION ALL ".join(
        f"SELECT m.series_id, m.ts, CAST(k.k * {len(drivers)} + {i} AS BIGINT) AS pos, b.{d} AS v FROM met m CROSS JOIN (SELECT unnest(range(0, {lags})) AS k) k "
        f"JOIN met b ON b.series_id = m.series_id AND b.ts = m.ts - to_hours(CAST(k.k AS INT))" for i, d in enumerate(drivers))
    return f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY series_id, ts) AS full_n FROM ({parts})) WHERE full_n = {lags * len(drivers)}"


def ma_sql(col, w, unit="HOUR"):
    return f"avg({col}) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL {w - 1} {unit} PRECEDING AND CURRENT ROW)"


def n_sql(w, unit="HOUR"):
    return f"count(*) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL {w - 1} {unit} PRECEDING AND CURRENT ROW)"


SPEC1 = X.FeatureSpec(drivers=("t_c", "rh"), lags=6, windows=(), slow=False, ratio=False)


@query("w1_lag_embedding", f"SELECT series_id, ts, pos, {R('v')} AS v FROM ({lag_sql(['t_c', 'rh'], 6)})")
def w1(t):
    return vector_rows(X.build_features(t.met(), S, SPEC1))


@query("w2_causal_ma", f"SELECT series_id, ts, {R(ma_sql('qty', 7, 'DAY'))} AS qty_ma7, {R(ma_sql('qty', 30, 'DAY'))} AS qty_ma30, {R(ma_sql('qty', 365, 'DAY'))} AS qty_ma365 FROM ship")
def w2(t):
    """Prefix-sum means: the cost does not depend on the window length."""
    return r6(X.causal_means(t.ship(), S, ["qty"], (7, 30, 365), step=DAY).select("series_id", "ts", "qty_ma7", "qty_ma30", "qty_ma365"))


@query("w3_strict_ma", f"SELECT series_id, ts, CASE WHEN {n_sql(6)} = 6 THEN {R(ma_sql('y', 6))} END AS y_ma6 FROM met")
def w3(t):
    return r6(X.causal_means(t.met(), S, ["y"], (6,), strict=True).select("series_id", "ts", "y_ma6"))


RHO = "(610.94e0*exp(17.625e0*{0}/(243.04e0+{0}))/(461.5e0*({0}+273.15e0)))"
Q = f"(least(greatest(rh,0),100)/100e0*{RHO.format('t_c')})"


def ratio_sql(w):
    return f"least(greatest({ma_sql('q', w)}/{RHO.format('(' + ma_sql('t_c', w) + ')')}*100e0,0e0),120e0)"


@query("w4_slow_ratio", f"SELECT series_id, ts, {R(ratio_sql(24))} AS ratio_ma24, {R(ratio_sql(72))} AS ratio_ma72 FROM (SELECT *, {Q} AS q FROM met)")
def w4(t):
    m = t.met().withColumn("q", X.vapour_density("rh", "t_c"))
    d = X.causal_means(m, S, ["q", "t_c"], (24, 72))
    return r6(d.select("series_id", "ts", *[X.slow_ratio(F.col(f"q_ma{w}"), F.col(f"t_c_ma{w}")).alias(f"ratio_ma{w}") for w in (24, 72)]))


SITE_SMALL = X.FeatureSpec(drivers=("t_c", "rh"), lags=3, windows=(3, 6), ratio=False, strict=True, mean_of=("t_c", "rh"))
ESH = "(6.112e0*exp(17.62e0*t_c/(243.12e0+t_c)))"
W5 = f"""WITH lg AS ({lag_sql(['t_c', 'rh'], 3)}), mm AS (SELECT series_id, ts, CASE WHEN {n_sql(6)} = 6 THEN 1 END AS ok,
    [{ma_sql('t_c', 3)}, {ma_sql('rh', 3)}, {ma_sql('t_c', 6)}, {ma_sql('rh', 6)}, {ESH}, rh*{ESH}] AS extra FROM met)
    SELECT series_id, ts, pos, {R('v')} AS v FROM lg JOIN mm USING (series_id, ts) WHERE ok = 1 UNION ALL
    SELECT series_id, ts, 6 + i AS pos, {R('extra[i + 1]')} AS v FROM mm CROSS JOIN (SELECT unnest(range(0, 6)) AS i) WHERE ok = 1"""


@query("w5_site_features", W5)
def w5(t):
    """Two-driver vector: lags, strict means, saturation pressure and its product with humidity."""
    m = t.met()
    return vector_rows(X.with_saturation_terms(X.build_features(m, S, SITE_SMALL), m, S))


YEAR_SMALL = X.FeatureSpec(drivers=("t_c", "rh", "rain", "wind", "p_hpa"), lags=2, windows=(3,), ratio=False, strict=True,
                           mean_of=("t_c", "rh", "rain", "wind", "p_hpa"))
FIVE = ["t_c", "rh", "rain", "wind", "p_hpa"]
W6 = f"""WITH lg AS ({lag_sql(FIVE, 2)}), mm AS (SELECT series_id, ts, {n_sql(3)} AS n3, [{', '.join(ma_sql(d, 3) for d in FIVE)},
      sin(2*pi()*hour(ts + INTERVAL 24 HOUR)/24), cos(2*pi()*hour(ts + INTERVAL 24 HOUR)/24), sin(2*pi()*dayofyear(ts + INTERVAL 24 HOUR)/365.25),
      cos(2*pi()*dayofyear(ts + INTERVAL 24 HOUR)/365.25)] AS extra FROM met)
    SELECT series_id, ts, pos, {R('v')} AS v FROM lg JOIN mm USING (series_id, ts) WHERE n3 = 3 UNION ALL
    SELECT series_id, ts, 10 + i AS pos, {R('extra[i + 1]')} AS v FROM mm CROSS JOIN (SELECT unnest(range(0, 9)) AS i) WHERE n3 = 3"""


@query("w6_year_features", W6)
def w6(t):
    """Five-driver vector with strict means and the calendar of the valid time."""
    return vector_rows(X.with_calendar_terms(X.build_features(t.met(), S, YEAR_SMALL), add_hours("ts", 24)))


@query("w7_target_lead", "SELECT m.series_id, m.ts, " + ", ".join(f"l{h}.y AS y{h}" for h in (24, 48, 72)) + " FROM met m " +
       " ".join(f"LEFT JOIN met l{h} ON l{h}.series_id = m.series_id AND l{h}.ts = m.ts + INTERVAL {h} HOUR" for h in (24, 48, 72)))
def w7(t):
    d = X.target_leads(t.met(), S, "y", (24, 48, 72))
    return d.select("series_id", "ts", *[F.get("labels", F.lit(i)).alias(f"y{h}") for i, h in enumerate((24, 48, 72))])


@query("w8_feature_family", f"""SELECT series_id, ts, CAST(row_number() OVER (PARTITION BY series_id, ts ORDER BY pos) - 1 AS BIGINT) AS pos, {R('v')} AS v
    FROM ({lag_sql(['t_c', 'rh'], 6)}) WHERE pos % 2 = 1 AND pos < 8""")
def w8(t):
    """Ablation by name: humidity lags below four hours only."""
    names = SPEC1.names()
    keep = {f"rh_lag{k}" for k in range(4)}
    f = X.build_features(t.met(), S, SPEC1)
    return vector_rows(f.withColumn("psi", X.feature_subset(F.col("psi"), names, lambda n: n in keep)))


@query("w9_standardise", f"""SELECT series_id, ts, {R('(t_c - avg(t_c) OVER w)/stddev_pop(t_c) OVER w')} AS z_t_c, {R('(rh - avg(rh) OVER w)/stddev_pop(rh) OVER w')} AS z_rh
    FROM met WINDOW w AS (PARTITION BY series_id)""")
def w9(t):
    m = t.met().select("series_id", "ts", "t_c", "rh")
    return r6(X.standardise(m, X.standardiser(m, S, ["t_c", "rh"]), S, ["t_c", "rh"]).select("series_id", "ts", "z_t_c", "z_rh"))


@query("w10_pooled_scale", f"SELECT {R('avg(t_c)')} AS mu_t_c, {R('stddev_pop(t_c)')} AS sd_t_c, {R('avg(rh)')} AS mu_rh, {R('stddev_pop(rh)')} AS sd_rh FROM met WHERE series_id <> 'view'")
def w10(t):
    """Moments of all source rows (one site held out); no subsample is needed."""
    return r6(X.standardiser(t.met().where("series_id <> 'view'"), [], ["t_c", "rh"]))


@query("w11_mean_of_domain_stats", f"SELECT {R('avg(m)')} AS mu, {R('avg(s)')} AS sd FROM (SELECT avg(rh) AS m, stddev_pop(rh) AS s FROM met WHERE series_id <> 'view' GROUP BY series_id)")
def w11(t):
    return r6(X.mean_of_domain_stats(t.met().where("series_id <> 'view'"), S, "rh"))


@query("w12_supervised_windows", f"""SELECT series_id, ts, {R('past_rh')} AS past_rh, {R('future_t')} AS future_t, {R('truth_y')} AS truth_y, {R('past_place', 4)} AS past_place, {R('truth_place', 4)} AS truth_place FROM (SELECT series_id, ts,
    sum((h + 1)*rh) OVER p - (h - 12)*sum(rh) OVER p AS past_place, sum((h + 1)*y) OVER f - h*sum(y) OVER f AS truth_place, count(*) OVER p AS np, count(*) OVER f AS nf, sum(rh) OVER p AS past_rh, sum(t_c) OVER f AS future_t, sum(y) OVER f AS truth_y FROM (SELECT *, CAST(epoch(ts) AS BIGINT) // 3600 - 473352 AS h FROM met)
    WINDOW p AS (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING),
           f AS (PARTITION BY series_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 5 HOUR FOLLOWING)) WHERE np = 12 AND nf = 6 AND (CAST(epoch(ts) AS BIGINT) // 3600) % 3 = 0""")
def w12(t):
    d = X.supervised_windows(t.met_core(), S, ["t_c", "rh"], "y", past=12, ahead=6, every=3)

    def total(arr):
        return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)

    def by_place(arr):
        return total(F.transform(arr, lambda v, i: v * (i + 1)))

    return r6(d.select("series_id", "ts", total(F.transform("past", lambda s: s["rh"])).alias("past_rh"),
                       total(F.transform("future", lambda s: s["t_c"])).alias("future_t"), total(F.col("truth")).alias("truth_y"),
                       by_place(F.transform("past", lambda s: s["rh"])).alias("past_place"), by_place(F.col("truth")).alias("truth_place")).withColumns(
                           {c: F.round(c, 4) for c in ("past_place", "truth_place")}))


@query("w13_spliced_readout", f"""WITH lg AS ({lag_sql(['t_c', 'rh'], 4)}), dot AS (SELECT series_id, ts, sum(v/(pos + 1)) AS d FROM lg GROUP BY 1, 2),
    ok AS (SELECT series_id, ts FROM (SELECT series_id, ts, count(*) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND INTERVAL 6 HOUR FOLLOWING) AS c FROM met) WHERE c = 10)
    SELECT ok.series_id, ok.ts, s.step, {R('d')} AS readout FROM ok CROSS JOIN (SELECT unnest(range(1, 7)) AS step) s
    JOIN dot ON dot.series_id = ok.series_id AND dot.ts = ok.ts + to_hours(CAST(s.step AS INT))""")
def w13(t):
    """History and a driver trajectory spliced, cut per step, newest first, and read out linearly."""
    row = F.array("t_c", "rh")
    d = windowed(t.met_core(), S, lambda f: {"h": F.collect_list(row).over(f.between(-3, 0)), "g": F.collect_list(row).over(f.between(1, 6))}, back=4, ahead=6)
    w = X.splice_windows(d.where((F.size("h") == 4) & (F.size("g") == 6)), F.col("h"), F.col("g"), 6, 4)
    weights = F.array(*[F.lit(1.0 / (i + 1)) for i in range(8)])
    dot = F.aggregate(F.zip_with("window", weights, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return r6(w.select("series_id", "ts", F.col("step").cast("long").alias("step"), dot.alias("readout")))


@query("w14_future_max", "SELECT series_id, ts, max(y) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 72 HOUR FOLLOWING) AS future_max FROM met")
def w14(t):
    return X.future_max(t.met_core(), S, "y", 72).select("series_id", "ts", "future_max")


@query("w15_hold_first", """SELECT series_id, ts, first_value(t_c) OVER (PARTITION BY series_id, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'train' WHEN ts < TIMESTAMP '2024-01-21' THEN 'val' ELSE 'test' END ORDER BY ts) AS held FROM met""")
def w15(t):
    m = t.met_core().withColumn("split", split_of("ts"))
    return X.hold_first(m, ["series_id", "split"], "t_c").select("series_id", "ts", "held")


@query("j1_asof_nearest", """WITH p AS (SELECT e.event_id, e.event_type AS series_id, e.ts, m.ts AS tp, m.y AS yp FROM events e ASOF LEFT JOIN met m ON m.series_id = e.event_type AND e.ts >= m.ts),
    n AS (SELECT e.event_id, m.ts AS tn, m.y AS yn FROM events e ASOF LEFT JOIN met m ON m.series_id = e.event_type AND e.ts <= m.ts),
    b AS (SELECT *, ts - tp AS dp, tn - ts AS dn FROM p JOIN n USING (event_id))
    SELECT event_id, series_id, ts, CASE WHEN up THEN tp WHEN dn <= INTERVAL 30 MINUTE THEN tn END AS met_ts, CASE WHEN up THEN yp WHEN dn <= INTERVAL 30 MINUTE THEN yn END AS y
    FROM (SELECT *, coalesce(dp <= INTERVAL 30 MINUTE AND (dn IS NULL OR dp <= dn), false) AS up FROM b)""")
def j1(t):
    left = t.events.select("event_id", F.col("event_type").alias("series_id"), "ts")
    right = t.met().select("series_id", F.col("ts").alias("met_ts"), "y")
    return J.asof_nearest(left, right, S, "ts", "met_ts", 1800)


@query("j2_calendar_lookup", f"""SELECT s.series_id, s.ts, s.n, {R('c.clim')} AS clim FROM sales s LEFT JOIN (SELECT series_id, month(ts) AS mo, day(ts) AS dy, avg(n) AS clim
    FROM sales WHERE ts < TIMESTAMP '1998-01-01' GROUP BY 1, 2, 3) c ON c.series_id = s.series_id AND c.mo = month(s.ts) AND c.dy = day(s.ts)""")
def j2(t):
    s = t.sales().select("series_id", "ts", "n")
    parts = {"mo": F.month("ts"), "dy": F.dayofmonth("ts")}
    table = s.where(F.col("ts") < ts_lit("1998-01-01 00:00:00")).withColumns(parts).groupBy("series_id", "mo", "dy").agg(F.avg("n").alias("clim"))
    return r6(J.calendar_lookup(s, table, parts, S).select("series_id", "ts", "n", "clim"))


@query("j3_zone_pairs", "SELECT a.ts, a.y AS y_click, b.y AS y_view FROM met a JOIN met b USING (ts) WHERE a.series_id = 'click' AND b.series_id = 'view'")
def j3(t):
    return J.zone_pairs(t.met_core(), ["ts"], "series_id", "y", "click", "view")


def staged_cuts(t):
    f = stage(t.fct())
    return f, calibrate_cuts(f.where("split = 'val'"), KEYS)


@query("j4_cut_lookup", f"WITH {CUTS_SQL}, {TEST_SQL} SELECT series_id, model, horizon_h, threshold, origin_ts, y_pred, cut, y_pred >= cut AS alarm FROM test")
def j4(t):
    f, cuts = staged_cuts(t)
    test = J.attach_cuts(f.where("split = 'test'"), cuts.select(*KEYS, F.round("cut", 6).alias("cut")), KEYS)
    return test.select(*KEYS, "origin_ts", "y_pred", "cut", (F.col("y_pred") >= F.col("cut")).alias("alarm"))


RM = "sqrt(avg((y_pred-y_true)*(y_pred-y_true)))"


@query("j5_model_comparison", f"""WITH s AS (SELECT series_id, horizon_h, model, {RM} AS rmse FROM fc GROUP BY 1, 2, 3)
    SELECT a.series_id, a.horizon_h, {R('a.rmse')} AS persistence, {R('b.rmse')} AS mean24, {R('c.rmse')} AS climatology, {R('b.rmse - a.rmse')} AS gain, b.rmse < a.rmse AS better
    FROM s a JOIN s b USING (series_id, horizon_h) JOIN s c USING (series_id, horizon_h) WHERE a.model = 'persistence' AND b.model = 'mean24' AND c.model = 'climatology'""")
def j5(t):
    k = ["series_id", "horizon_h"]
    m = regression_metrics(t.fc(), [*k, "model"])
    p = J.by_label(m, k, "model", ["persistence", "mean24", "climatology"], "rmse")
    return r6(p.withColumn("gain", F.col("mean24") - F.col("persistence")).withColumn("better", F.col("gain") < 0))


@query("j6_reference_comparison", f"""WITH m AS (SELECT 'mean' AS metric, avg(y) AS model_value FROM met WHERE series_id <> 'view' UNION ALL SELECT 'max', max(y) FROM met WHERE series_id <> 'view'),
    r AS (SELECT 'mean' AS metric, avg(y) AS ref_value FROM met WHERE series_id = 'view' UNION ALL SELECT 'max', max(y) FROM met WHERE series_id = 'view')
    SELECT metric, {R('model_value')} AS model_value, {R('ref_value')} AS ref_value, {R('model_value - ref_value')} AS diff FROM m JOIN r USING (metric)""")
def j6(t):
    m = t.met_core()

    def stats(df, out):
        return df.agg(F.avg("y").alias("mean"), F.max("y").alias("max")).unpivot([], ["mean", "max"], "metric", out)

    return r6(J.against_reference(stats(m.where("series_id <> 'view'"), "model_value"), stats(m.where("series_id = 'view'"), "ref_value")))


@query("j7_parameter_grid", """SELECT s.series_id, s.n, a.alpha, h.horizon_h, t.threshold FROM (SELECT series_id, count(*) AS n FROM met GROUP BY 1) s
    CROSS JOIN (SELECT unnest([0.1e0, 0.5e0, 0.9e0]) AS alpha) a CROSS JOIN (SELECT unnest([24, 48, 72]) AS horizon_h) h CROSS JOIN (SELECT unnest([62e0, 67e0, 75e0]) AS threshold) t""")
def j7(t):
    s = t.met().groupBy("series_id").agg(F.count("*").alias("n"))
    return J.with_grid(s, alpha=[0.1, 0.5, 0.9], horizon_h=[24, 48, 72], threshold=list(THRESHOLDS))


@query("j8_alarm_before_onset", f"WITH {CUTS_SQL}, {TEST_SQL}, {LEAD_SQL} SELECT series_id, model, horizon_h, threshold, valid_ts, lead_h FROM leads")
def j8(t):
    f, cuts = staged_cuts(t)
    test = f.where("split = 'test'").join(cuts.select(*KEYS, F.round("cut", 6).alias("cut")), KEYS)
    return onset_leads(test, KEYS)


@query("j9_kept_and_dropped", """WITH g AS (SELECT series_id FROM sales GROUP BY 1 HAVING count(*) >= 500)
    SELECT series_id, 'kept' AS side FROM (SELECT DISTINCT series_id FROM sales) WHERE series_id IN (SELECT series_id FROM g)
    UNION ALL SELECT series_id, 'dropped' FROM (SELECT DISTINCT series_id FROM sales) WHERE series_id NOT IN (SELECT series_id FROM g)""")
def j9(t):
    s = t.sales()
    g = domain_guards(s, S, "cents", 500, 0.0)
    kept = kept_domains(s, g, S).select("series_id").distinct().withColumn("side", F.lit("kept"))
    return kept.unionByName(dropped_domains(s, g, S).withColumn("side", F.lit("dropped")))


# ---- the vectors and windows at full size -------------------------------------------------------

def full_sql(drivers, spec, extra):
    """Lags, strict means and ``extra`` expressions of ``spec``."""
    n, last = spec.lags * len(drivers), max(spec.windows)
    means = [ma_sql(d, w) for w in spec.windows for d in drivers]
    return f"""WITH lg AS ({lag_sql(drivers, spec.lags)}), mm AS (SELECT series_id, ts, {n_sql(last)} AS full_rows, [{', '.join([*means, *extra])}] AS extra FROM met)
    SELECT series_id, ts, pos, {R('v')} AS v FROM lg JOIN mm USING (series_id, ts) WHERE full_rows = {last} UNION ALL
    SELECT series_id, ts, {n} + i AS pos, {R('extra[i + 1]')} AS v FROM mm CROSS JOIN (SELECT unnest(range(0, {len(means) + len(extra)})) AS i) WHERE full_rows = {last}"""


@query("w5_site_features_full", full_sql(["t_c", "rh"], X.SITE_SPEC, [ESH, f"rh*{ESH}"]))
def w5_full(t):
    """24 lags, means over 6, 24 and 72 hours."""
    m = t.met()
    return vector_rows(X.with_saturation_terms(X.build_features(m, S, X.SITE_SPEC), m, S))


VALID = "ts + INTERVAL 24 HOUR"


@query("w6_year_features_full", full_sql(FIVE, X.YEAR_SPEC, [f"{f}(2*pi()*{part}({VALID})/{n})" for part, n in (("hour", 24), ("dayofyear", 365.25)) for f in ("sin", "cos")]))
def w6_full(t):
    """24 lags, means over 24, 72 and 168 hours."""
    return vector_rows(X.with_calendar_terms(X.build_features(t.met(), S, X.YEAR_SPEC), add_hours("ts", 24)))


@query("w12_supervised_windows_full", f"""SELECT series_id, ts, {R('past_rh')} AS past_rh, {R('future_t')} AS future_t, {R('truth_y')} AS truth_y, {R('past_place', 4)} AS past_place, {R('truth_place', 4)} AS truth_place FROM (SELECT series_id, ts,
    sum((h + 1)*rh) OVER p - (h - 168)*sum(rh) OVER p AS past_place, sum((h + 1)*y) OVER f - h*sum(y) OVER f AS truth_place, count(*) OVER p AS np, count(*) OVER f AS nf, sum(rh) OVER p AS past_rh, sum(t_c) OVER f AS future_t, sum(y) OVER f AS truth_y FROM (SELECT *, CAST(epoch(ts) AS BIGINT) // 3600 - 473352 AS h FROM met)
    WINDOW p AS (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 168 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING),
           f AS (PARTITION BY series_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 71 HOUR FOLLOWING)) WHERE np = 168 AND nf = 72 AND (CAST(epoch(ts) AS BIGINT) // 3600) % 3 = 0""")
def w12_full(t):
    """A week back, three days ahead."""
    d = X.supervised_windows(t.met_core(), S, ["t_c", "rh"], "y")

    def total(arr):
        return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)

    def by_place(arr):
        return total(F.transform(arr, lambda v, i: v * (i + 1)))

    return r6(d.select("series_id", "ts", total(F.transform("past", lambda s: s["rh"])).alias("past_rh"),
                       total(F.transform("future", lambda s: s["t_c"])).alias("future_t"), total(F.col("truth")).alias("truth_y"),
                       by_place(F.transform("past", lambda s: s["rh"])).alias("past_place"), by_place(F.col("truth")).alias("truth_place")).withColumns(
                           {c: F.round(c, 4) for c in ("past_place", "truth_place")}))
