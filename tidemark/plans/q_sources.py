"""Sources, sinks and cleaning."""

import uuid

from pyspark.sql import functions as F

from ..functions.calendar import add_hours, hour_floor, to_local, to_utc
from ..functions.labels import display_label
from ..operators import clean
from ..operators.chunks import complete_grid
from ..operators.metrics import regression_metrics
from ..session import checkpoint_dir
from ..sources import loggers, stations, tables, weather
from .registry import R, query, r6
from .series import split_of, ts_lit

S = ["series_id"]


def scratch(t, name):
    return f"{checkpoint_dir(t.spark)}/out/{name}-{uuid.uuid4().hex}"


@query("s1_weather_json", """SELECT series_id, ts, CASE WHEN n % 5 <> 0 THEN t_c END AS "T2M", rh AS "RH2M", wind AS "WS10M" FROM met""")
def s1(t):
    """Hourly drivers written as nested JSON per day, read back through the payload parser."""
    key = F.date_format("ts", "yyyyMMddHH")

    def series(c):
        return F.map_from_entries(F.collect_list(F.struct(key, c)))

    par = F.create_map(F.lit("T2M"), series(F.when(F.col("n") % 5 == 0, F.lit(-999.0)).otherwise(F.col("t_c"))),
                       F.lit("RH2M"), series(F.col("rh")), F.lit("WS10M"), series(F.col("wind")))
    text = F.to_json(F.struct(F.struct(par.alias("parameter")).alias("properties")))
    docs = t.met().groupBy("series_id", F.to_date("ts")).agg(text.alias("value"))
    return weather.parse_weather(docs.select("series_id", "value"), variables=("T2M", "RH2M", "WS10M"))


@query("s2_dedup_first", """SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, min(event_id) AS event_id,
    arg_min(value, event_id) AS value FROM events GROUP BY 1, 2""")
def s2(t):
    ev = t.events.select(F.col("event_type").alias("series_id"), hour_floor("ts").alias("ts"), "event_id", "value")
    return clean.keep_first(ev, ["series_id", "ts"], ["event_id"])


REPORT = ["STATION", "DATE", "TMP", "DEW", "SLP", "REM"]


def report_lines(t):
    q = F.lit('"')

    def field(x):
        return F.concat(q, x, q)

    v = F.round(F.col("value") * 10).cast("int")
    tmp = F.when(F.col("event_id") % 11 == 0, F.lit("+9999,9")).otherwise(F.concat(F.format_string("%+05d", v), F.lit(",1")))
    slp = F.concat((F.lit(10000) + F.col("user_id")).cast("string"), F.lit(",1"))
    rem = F.when(F.col("event_id") % 17 == 0, F.lit('MET" odd')).otherwise(F.lit("MET, fine"))
    full = F.concat_ws(",", field(F.col("event_id").cast("string")), field(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")),
                       field(tmp), field(F.lit("+0012,1")), field(slp), field(rem))
    short = F.concat_ws(",", field(F.col("event_id").cast("string")), field(F.lit("x")))
    return t.events.select(F.when(F.col("event_id") % 13 == 0, short).otherwise(full).alias("value"))


@query("s3_station_reports", """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "DATE",
    CASE WHEN event_id % 11 = 0 THEN '+9999,9' ELSE printf('%+05d', CAST(round(value*10) AS INT)) || ',1' END AS "TMP", '+0012,1' AS "DEW",
    CAST(10000 + user_id AS VARCHAR) || ',1' AS "SLP" FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0""")
def s3(t):
    """Broken quotes and short records are skipped; quoted commas survive."""
    return stations.parse_report_lines(report_lines(t), REPORT)


@query("s4_station_decode", """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(round(value*10) AS INT) / 10e0 END AS tmp_c,
    CAST(NULL AS DOUBLE) AS bad, (10000 + user_id) / 10e0 AS slp_hpa FROM events""")
def s4(t):
    v = F.round(F.col("value") * 10).cast("int")
    raw = t.events.select("event_id", "user_id", F.when(F.col("event_id") % 11 == 0, F.lit("+9999,9"))
                          .otherwise(F.concat(F.format_string("%+05d", v), F.lit(",1"))).alias("tmp"))
    slp = F.concat((F.lit(10000) + F.col("user_id")).cast("string"), F.lit(",1"))
    return raw.select("event_id", stations.decode(F.col("tmp")).alias("tmp_c"),
                      stations.decode(F.lit("n/a,1")).alias("bad"), stations.decode(slp).alias("slp_hpa"))


def logger_cube(t):
    """One row per (series, day): parallel arrays of at most 24 readings, NaN where n = 1."""
    nan = F.lit(float("nan"))
    row = F.array_sort(F.collect_list(F.struct("ts", (F.col("t_c") + 273.15).alias("k"),
                                               F.when(F.col("n") == 1, nan).otherwise(F.col("rh")).alias("rh"))))
    c = t.met().groupBy("series_id", F.to_date("ts").alias("day")).agg(row.alias("r"))
    onehot = F.transform(F.array(*[F.lit(x) for x in ("click", "error", "signup", "view")]), lambda v: (v == F.col("series_id")).cast("int"))
    return c.select(F.col("series_id").alias("logger"), loggers.site_index(onehot).alias("site"),
                    F.col("r.ts").alias("times"), F.col("r.k").alias("temp_k"), F.col("r.rh").alias("rh"))


@query("s5_logger_cube", f"""SELECT series_id AS logger, CASE series_id WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE -1 END AS site,
    ts, {R('t_c + 273.15e0 - 273.15e0')} AS temp_c, CASE WHEN n <> 1 THEN rh END AS rh FROM met""")
def s5(t):
    return r6(loggers.cube_to_long(logger_cube(t), carry=("site",)))


@query("s6_interim_rows", """SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2""")
def s6(t):
    """Text lines parsed with an explicit schema, then sorted out to the first row per key."""
    lines = t.events.select("event_id", F.concat_ws(",", "event_type", F.date_format(hour_floor("ts"), "yyyy-MM-dd HH:mm:ss"),
                                                    F.col("value").cast("string")).alias("line"))
    rec = F.from_csv("line", "series_id STRING, ts TIMESTAMP_NTZ, value DOUBLE", {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"})
    rows = lines.select("event_id", rec.alias("r")).select("event_id", "r.*")
    return clean.keep_first(rows, ["series_id", "ts"], ["event_id"]).select("series_id", "ts", "value")


SCORE_SQL = f"""SELECT series_id, model, horizon_h, count(*) AS n, {R('sqrt(avg((y_pred-y_true)*(y_pred-y_true)))')} AS rmse,
    {R('avg(abs(y_pred-y_true))')} AS mae FROM fc GROUP BY 1, 2, 3"""


def score_table(t):
    return r6(regression_metrics(t.fc(), ["series_id", "model", "horizon_h"]).select("series_id", "model", "horizon_h", "n", "rmse", "mae"))


@query("s7_metric_csv", SCORE_SQL)
def s7(t):
    """Metric table written as CSV and read back with its schema."""
    path = scratch(t, "metrics")
    tables.write_csv(score_table(t), path)
    return t.spark.read.csv(path, header=True, schema="series_id STRING, model STRING, horizon_h INT, n LONG, rmse DOUBLE, mae DOUBLE")


@query("s8_summary_json", f"WITH s AS ({SCORE_SQL}) SELECT series_id, model, horizon_h, rmse, mae FROM s")
def s8(t):
    """Nested summary {{model: {{metric: value}}}} written as JSON text and unfolded again."""
    path = scratch(t, "summary")
    tables.write_json(tables.summary_json(score_table(t), ["series_id", "horizon_h"], "model", ["rmse", "mae"]), path)
    back = t.spark.read.json(path, schema="series_id STRING, horizon_h INT, summary STRING")
    m = F.from_json("summary", "MAP<STRING, STRUCT<rmse: DOUBLE, mae: DOUBLE>>")
    return back.select("series_id", "horizon_h", F.explode(m).alias("model", "v")).select("series_id", "model", "horizon_h", "v.rmse", "v.mae")


@query("s10_dashboard_extract", f"SELECT series_id, ts, {R('t_c', 1)} AS t_c, {R('y', 1)} AS y FROM met WHERE ts >= TIMESTAMP '2024-01-21'")
def s10(t):
    path = scratch(t, "dash")
    tables.write_json(tables.dashboard_rows(t.met().where(F.col("ts") >= ts_lit("2024-01-21 00:00:00")),
                                            {"series_id": None, "ts": None, "t_c": 1, "y": 1}), path)
    return t.spark.read.json(path, schema="series_id STRING, ts TIMESTAMP_NTZ, t_c DOUBLE, y DOUBLE")


@query("p1_timezone", "SELECT event_id, ts + INTERVAL 8 HOUR AS ts_local, ts AS ts_utc FROM events")
def p1(t):
    e = t.events.select("event_id", to_local("ts", "Asia/Shanghai").alias("ts_local"))
    return e.select("event_id", "ts_local", to_utc("ts_local", "Asia/Shanghai").alias("ts_utc"))


@query("p2_quality_report", "WITH u AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, {v} AS v FROM grid" for v in ("t_c", "rh", "y")) +
    f""") SELECT variable, count(*) AS n, count(*) FILTER (v IS NULL) AS missing, {R('avg(CASE WHEN v IS NULL THEN 1e0 ELSE 0e0 END)', 4)} AS missing_rate,
    {R('min(v)', 3)} AS min, {R('avg(v)', 3)} AS mean, {R('max(v)', 3)} AS max FROM u GROUP BY 1""")
def p2(t):
    return clean.quality_report(complete_grid(t.met_core(), S), ["t_c", "rh", "y"])


@query("p3_paired_rows", "SELECT series_id, ts, y, CASE WHEN n > 1 THEN rh END AS p FROM met WHERE n > 1")
def p3(t):
    m = t.met().select("series_id", "ts", "y", F.when(F.col("n") > 1, F.col("rh")).otherwise(F.lit(float("nan"))).alias("p"))
    return clean.paired(m, "y", "p")


@query("p4_split_by_time", """SELECT series_id, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'train' WHEN ts < TIMESTAMP '2024-01-21' THEN 'val' ELSE 'test' END AS split,
    count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM met GROUP BY 1, 2""")
def p4(t):
    return (t.met().groupBy("series_id", split_of("ts").alias("split"))
            .agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


@query("p5_split_by_fraction", """SELECT series_id, ts, CASE WHEN pos < floor(n*0.6) THEN 'train' WHEN pos < floor(n*0.6) + floor(n*0.2) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM met)""")
def p5(t):
    return clean.split_by_fraction(t.met(), S).select("series_id", "ts", "split")


@query("p6_valid_units", """SELECT m.series_id, m.ts, m.y FROM met m JOIN (SELECT series_id FROM met GROUP BY 1
    HAVING count(CASE WHEN n > 1 THEN rh END) >= 300 AND count(CASE WHEN t_c > 0 THEN t_c END) >= 200) USING (series_id)""")
def p6(t):
    m = t.met().withColumn("rh_ok", F.when(F.col("n") > 1, F.col("rh"))).withColumn("t_ok", F.when(F.col("t_c") > 0, F.col("t_c")))
    ok = clean.valid_units(clean.valid_units(m, S, ["rh_ok"], 300).join(m, S), S, ["t_ok"], 200)
    return m.join(ok, S, "left_semi").select("series_id", "ts", "y")


UNITS = "SELECT user_id % 40 AS logger, user_id % 4 AS site, CASE WHEN user_id % 3 = 0 THEN 'Light' ELSE 'Dark' END AS zone, * FROM events"


def units(t):
    u = F.col("user_id")
    return t.events.select("*", (u % 40).alias("logger"), (u % 4).alias("site"), F.when(u % 3 == 0, "Light").otherwise("Dark").alias("zone"))


@query("p7_best_unit", f"""WITH u AS ({UNITS}), c AS (SELECT site, zone, logger, count(*) AS n FROM u GROUP BY 1, 2, 3)
    SELECT site, zone, logger, n FROM (SELECT *, row_number() OVER (PARTITION BY site, zone ORDER BY n DESC, logger) AS rk FROM c) WHERE rk = 1""")
def p7(t):
    c = units(t).groupBy("site", "zone", "logger").agg(F.count("*").alias("n"))
    return clean.best_unit(c, ["site", "zone"], "logger", "n")


GUARD = """SELECT series_id, count(cents) AS n_rows, round(stddev_pop(cents/100e0), 4) + 0e0 AS target_sd,
    CASE WHEN count(cents) < 400 THEN 'too_few' WHEN stddev_pop(cents/100e0) < 0.5 THEN 'flat' ELSE 'kept' END AS reason FROM sales GROUP BY 1"""


@query("p8_domain_guards", GUARD)
def p8(t):
    s = t.sales().withColumn("target", F.col("cents") / 100.0)
    return r6(clean.domain_guards(s, S, "target", 400, 0.5), 4)


@query("p9_same_year_label", """SELECT a.series_id, a.ts, b.qty AS label FROM ship a JOIN ship b ON b.series_id = a.series_id AND b.ts = a.ts + INTERVAL 30 DAY
    WHERE year(a.ts) = year(b.ts)""")
def p9(t):
    s = t.ship()
    lead = s.select("series_id", F.timestamp_add("DAY", F.lit(-30), "ts").alias("ts"), F.col("ts").alias("lead_ts"), F.col("qty").alias("label"))
    return s.join(lead, ["series_id", "ts"]).where(F.year("ts") == F.year("lead_ts")).select("series_id", "ts", "label")


@query("p10_stride", """SELECT series_id, ts, y FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos FROM met) WHERE pos % 3 = 0""")
def p10(t):
    return clean.stride(t.met(), S, 3).select("series_id", "ts", "y")


@query("p11_warmup_backfill", """WITH l AS (SELECT a.series_id, a.ts, CAST(b.qty AS DOUBLE) AS q7 FROM ship a LEFT JOIN ship b ON b.series_id = a.series_id AND b.ts = a.ts - INTERVAL 7 DAY),
    f AS (SELECT series_id, min(ts) AS t0, arg_min(q7, ts) AS v0 FROM l WHERE q7 IS NOT NULL GROUP BY 1)
    SELECT l.series_id, l.ts, CASE WHEN l.ts < f.t0 THEN f.v0 ELSE l.q7 END AS q7 FROM l JOIN f USING (series_id)""")
def p11(t):
    s = t.ship().select("series_id", "ts", "qty")
    old = s.select("series_id", F.timestamp_add("DAY", F.lit(7), "ts").alias("ts"), F.col("qty").cast("double").alias("q7"))
    return clean.backfill_warmup(s.join(old, ["series_id", "ts"], "left").select("series_id", "ts", "q7"), S, ["q7"])


@query("p12_spinup", f"""SELECT series_id, count(*) FILTER (e) AS n_eval, {R('avg(y) FILTER (e)')} AS mean_eval, min(y) FILTER (e) AS min_eval, max(y) FILTER (e) AS max_eval,
    count(*) AS n_all, {R('avg(y)')} AS mean_all, min(y) AS min_all, max(y) AS max_all
    FROM (SELECT *, ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-25' AS e FROM met) GROUP BY 1""")
def p12(t):
    return r6(clean.with_and_without_spinup(t.met(), S, "y", ts_lit("2024-01-15 00:00:00"), ts_lit("2024-01-25 00:00:00")))


@query("p13_column_check", "WITH u AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS v FROM grid" for v in ("t_c", "rh", "y")) +
       f") SELECT variable, {R('avg(CASE WHEN v IS NULL THEN 0e0 ELSE 1e0 END)')} AS finite_share FROM u GROUP BY 1")
def p13(t):
    return r6(clean.column_check(complete_grid(t.met_core(), S), ["t_c", "rh", "y"]))


@query("p14_coverage_funnel", f"""WITH u AS ({UNITS}), c AS (SELECT site, zone, logger, count(*) AS n FROM u GROUP BY 1, 2, 3)
    SELECT site, count(*) FILTER (zone = 'Light') AS n_light, count(*) FILTER (zone = 'Dark') AS n_dark, count(*) FILTER (n >= 60) AS n_valid, CAST(sum(n) AS BIGINT) AS n_rows,
    CASE WHEN count(*) FILTER (zone = 'Light' AND n >= 60) = 0 THEN 'no light logger' WHEN count(*) FILTER (zone = 'Dark' AND n >= 60) = 0 THEN 'no dark logger' ELSE 'ok' END AS reason
    FROM c GROUP BY 1""")
def p14(t):
    c = units(t).groupBy("site", "zone", "logger").agg(F.count("*").alias("n"))
    light, dark, good = F.col("zone") == "Light", F.col("zone") == "Dark", F.col("n") >= 60
    return c.groupBy("site").agg(
        F.count_if(light).alias("n_light"), F.count_if(dark).alias("n_dark"), F.count_if(good).alias("n_valid"), F.sum("n").alias("n_rows"),
        F.when(F.count_if(light & good) == 0, "no light logger").when(F.count_if(dark & good) == 0, "no dark logger").otherwise("ok").alias("reason"))


@query("p15_unit_summary", f"""SELECT s_suppkey AS logger, n_name AS site, count(l_quantity) AS n_temp_c, {R('min(l_quantity - 273.15e0)')} AS min_temp_c,
    {R('avg(l_quantity - 273.15e0)')} AS mean_temp_c, {R('max(l_quantity - 273.15e0)')} AS max_temp_c
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""")
def p15(t):
    li = t.lineitem.select(F.col("l_suppkey").alias("logger"), (F.col("l_quantity") - 273.15).alias("temp_c"))
    meta = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("logger"), F.col("n_name").alias("site"))
    return r6(clean.unit_summary(li, ["logger"], ["temp_c"]).join(meta, "logger"))


@query("p16_display_label", """SELECT p_partkey, p_name AS label FROM part""")
def p16(t):
    raw = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")（draft）"))
    return t.part.select("p_partkey", display_label(raw).alias("label"))
