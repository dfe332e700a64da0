"""Scalar functions (F1-F25) over the derived series."""

from pyspark.sql import functions as F

from ..functions import calendar as C, labels as L, physics as P, scores as S
from .registry import R, query, r6

TAUS = (0.1, 0.5, 0.9, 0.95)
ES = "610.94e0*exp(17.625e0*t_c/(243.04e0+t_c))"
RHO = f"({ES}/(461.5e0*(t_c+273.15e0)))"
EB = "exp(17.67e0*{0}/(243.5e0+{0}))"


@query("f1_saturation", f"SELECT series_id, ts, {R(ES, 4)} AS es_pa FROM met")
def f1(t):
    return r6(t.met().select("series_id", "ts", P.saturation_pa("t_c").alias("es_pa")), 4)


@query("f2_saturation_variants", f"""SELECT series_id, ts, {R('611.2e0*exp(17.62e0*t_c/(243.12e0+t_c))', 4)} AS es_a, {R('611.2e0*exp(17.67e0*t_c/(243.5e0+t_c))', 4)} AS es_b FROM met""")
def f2(t):
    return r6(t.met().select("series_id", "ts", P.saturation_pa("t_c", P.MAGNUS_SONNTAG).alias("es_a"),
                             P.saturation_pa("t_c", P.MAGNUS_BOLTON).alias("es_b")), 4)


@query("f3_vapour_density", f"SELECT series_id, ts, {R(f'least(greatest(rh,0),100)/100e0*{RHO}', 9)} AS rho_v FROM met")
def f3(t):
    return r6(t.met().select("series_id", "ts", P.vapour_density("rh", "t_c").alias("rho_v")), 9)


@query("f4_humidity_from_density", f"SELECT series_id, ts, {R(f'least(greatest(wind/1000e0/{RHO}*100e0,0),100)')} AS rh_back FROM met")
def f4(t):
    return r6(t.met().select("series_id", "ts", P.relative_humidity(F.col("wind") / 1000.0, "t_c").alias("rh_back")))


@query("f5_humidity_from_dew", f"""SELECT series_id, ts, CASE WHEN dew IS NOT NULL THEN {R(f"least(greatest(100e0*{EB.format('dew')}/{EB.format('t_c')},0),100)")} END AS rh_td
    FROM (SELECT *, CASE WHEN n > 1 THEN t_c - rh/10e0 END AS dew FROM met)""")
def f5(t):
    m = t.met().withColumn("dew", F.when(F.col("n") > 1, F.col("t_c") - F.col("rh") / 10.0))
    return r6(m.select("series_id", "ts", P.humidity_from_dew("t_c", "dew").alias("rh_td")))


@query("f6_station_pressure", f"SELECT series_id, ts, {R('p_hpa*pow(1e0-7.41e0/(t_c+273.15e0+7.41e0),5.257e0)', 5)} AS ps_hpa FROM met")
def f6(t):
    return r6(t.met().select("series_id", "ts", P.station_pressure("p_hpa", "t_c").alias("ps_hpa")), 5)


@query("f7_units", f"SELECT series_id, ts, {R('wind - 273.15e0', 4)} AS c, {R('t_c*10e0', 4)} AS hpa FROM met")
def f7(t):
    return r6(t.met().select("series_id", "ts", P.kelvin_to_c("wind").alias("c"), P.kpa_to_hpa("t_c").alias("hpa")), 4)


@query("f8_calendar_encoding", "SELECT series_id, ts, " + ", ".join(f"{R(e)} AS {n}" for n, e in (
    ("hour_sin", "sin(2*pi()*hour(v)/24)"), ("hour_cos", "cos(2*pi()*hour(v)/24)"),
    ("year_sin", "sin(2*pi()*dayofyear(v)/365.25)"), ("year_cos", "cos(2*pi()*dayofyear(v)/365.25)"))) +
    " FROM (SELECT *, ts + INTERVAL 24 HOUR AS v FROM met)")
def f8(t):
    enc = C.calendar_encoding(C.add_hours("ts", 24))
    return r6(t.met().select("series_id", "ts", *[c.alias(n) for n, c in enc.items()]))


@query("f9_open_hours", "SELECT event_id, hour(ts + INTERVAL 8 HOUR) >= 8 AND hour(ts + INTERVAL 8 HOUR) < 18 AS open_flag, false AS closed_flag FROM events")
def f9(t):
    return t.events.select("event_id", C.is_open("ts").alias("open_flag"), C.is_open("ts", force_closed=True).alias("closed_flag"))


@query("f10_scenario_flow", f"""SELECT series_id, ts, {R('q')} AS flow, {R('q/500e0')} AS ach FROM (SELECT *, CASE WHEN hour(ts + INTERVAL 8 HOUR) BETWEEN 8 AND 17
    THEN 400e0 ELSE 40e0 END * CASE WHEN rain > 0 THEN 1.3e0 ELSE 1e0 END AS q FROM met)""")
def f10(t):
    flow = P.scenario_flow(C.is_open("ts"), "rain", 400, 40, 0.3)
    return r6(t.met().select("series_id", "ts", flow.alias("flow"), P.air_changes(flow, 500).alias("ach")))


@query("f11_clip", "SELECT series_id, ts, least(greatest(y*1.5e0-20e0, 0e0), 100e0) AS clipped FROM met")
def f11(t):
    return t.met().select("series_id", "ts", P.clip(F.col("y") * 1.5 - 20.0, 0, 100).alias("clipped"))


@query("f12_gate", f"SELECT series_id, ts, {R('1e0/(1e0+exp(-(y-67e0)/2e0))')} AS gate FROM met")
def f12(t):
    return r6(t.met().select("series_id", "ts", S.sigmoid_gate("y", 67.0, 2.0).alias("gate")))


@query("f13_lead_decay", f"SELECT series_id, model, origin_ts, horizon_h, {R('exp(-horizon_h/48e0)')} AS decay FROM fc")
def f13(t):
    return r6(t.fc().select("series_id", "model", "origin_ts", "horizon_h", S.lead_decay("horizon_h", 48.0).alias("decay")))


GATE = "(1e0/(1e0+exp(-(y_pred-67e0)/2e0)))"


@query("f14_tail_weights", f"""SELECT series_id, model, origin_ts, horizon_h, tau, {R(f'1e0 + 1.5e0*{GATE}*greatest(2e0*tau-1e0,0e0)*exp(-horizon_h/48e0)')} AS w_operator,
    {R('1e0 + 1.5e0*0.5e0*greatest(2e0*tau-1e0,0e0)*exp(-horizon_h/48e0)')} AS w_fixed, 1e0 AS w_none
    FROM fc CROSS JOIN (SELECT unnest([0.1e0,0.5e0,0.9e0,0.95e0]) AS tau)""")
def f14(t):
    def w(mode):
        return S.tail_weights("y_pred", "horizon_h", TAUS, gamma=1.5, mode=mode)

    z = F.arrays_zip(F.array(*[F.lit(x) for x in TAUS]).alias("tau"), w("operator").alias("w_operator"), w("fixed").alias("w_fixed"), w("none").alias("w_none"))
    return r6(t.fc().select("series_id", "model", "origin_ts", "horizon_h", F.inline(z).alias("tau", "w_operator", "w_fixed", "w_none")))


LEVELS = tuple(i / 65 for i in range(1, 65))


@query("f15_pinball", f"""SELECT vec_id, tau, {R('greatest(tau*(y-q),(tau-1e0)*(y-q))')} AS loss FROM (SELECT vec_id, y,
    unnest(list_transform(range(1, 65), lambda i: i/65e0)) AS tau, unnest(members) AS q FROM ensembles)""")
def f15(t):
    """All 64 members as quantile levels 1/65 … 64/65."""
    z = F.arrays_zip(F.array(*[F.lit(x) for x in LEVELS]).alias("tau"), S.pinball_vector("members", "y", LEVELS).alias("loss"))
    return t.ensembles().select("vec_id", F.inline(z).alias("tau", "loss")).withColumn("loss", F.round("loss", 6))


@query("f16_non_crossing", "SELECT vec_id, i - 1 AS pos, list_sort(members)[i] AS q FROM ensembles CROSS JOIN (SELECT unnest(range(1, 65)) AS i)")
def f16(t):
    return t.ensembles().select("vec_id", F.posexplode(S.non_crossing("members")).alias("pos", "q")).withColumn("pos", F.col("pos").cast("long"))


@query("f17_round_half_even", "SELECT event_id, round_even(value*10e0, 0) AS v0 FROM events")
def f17(t):
    return t.events.select("event_id", F.bround(F.col("value") * 10.0, 0).alias("v0"))


@query("f18_plot_floor", "SELECT series_id, ts, greatest(t_c, -1e0) AS shown, t_c < -1 AS truncated FROM met")
def f18(t):
    return t.met().select("series_id", "ts", F.greatest("t_c", F.lit(-1.0)).alias("shown"), (F.col("t_c") < -1).alias("truncated"))


@query("f19_percent_of_range", f"""SELECT series_id, ts, {R('least(pa,pb)')} AS band_left, {R('abs(pb-pa)')} AS band_width, {R('greatest(abs(pd-pc),0.8e0)')} AS span_width FROM (
    SELECT *, (rh-lo)/sp*100e0 AS pa, (y-lo)/sp*100e0 AS pb, (t_c-lo)/sp*100e0 AS pc, (wind-lo)/sp*100e0 AS pd FROM (
    SELECT *, least(rh,y,t_c,wind) AS lo, CASE WHEN greatest(rh,y,t_c,wind) > least(rh,y,t_c,wind) THEN greatest(rh,y,t_c,wind) - least(rh,y,t_c,wind) ELSE 1e0 END AS sp FROM met))""")
def f19(t):
    four = ("rh", "y", "t_c", "wind")
    m = t.met().withColumn("lo", F.least(*four)).withColumn("hi", F.greatest(*four))
    p = {c: F.coalesce(L.percent_of_range("lo", "hi", c), F.lit(0.0)) for c in four}
    return r6(m.select("series_id", "ts", F.least(p["rh"], p["y"]).alias("band_left"), F.abs(p["y"] - p["rh"]).alias("band_width"),
                       F.greatest(F.abs(p["wind"] - p["t_c"]), F.lit(0.8)).alias("span_width")))


@query("f20_lenient_parse", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END AS parsed FROM events")
def f20(t):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", C.parse_or_null(text, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("f21_format", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute_text, strftime(ts, '%Y-%m-%d') AS day_text FROM events")
def f21(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute_text"), F.date_format("ts", "yyyy-MM-dd").alias("day_text"))


PRIO = {"1-URGENT": "p1", "2-HIGH": "p2", "3-MEDIUM": "p3"}


@query("f22_short_key", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'p1' WHEN '2-HIGH' THEN 'p2' WHEN '3-MEDIUM' THEN 'p3' END AS short FROM orders")
def f22(t):
    return t.orders.select("o_orderkey", L.short_key("o_orderpriority", PRIO).alias("short"))


@query("f23_name_predicates", """SELECT p_partkey, CASE WHEN starts_with(nm, 'ratio') THEN 'ratio' WHEN contains(nm, '_ma') THEN 'slow_ma' ELSE 'fast_lag' END AS family,
    ends_with(nm, '4') AS is_24 FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ratio_ma' WHEN 1 THEN 'rh_ma' ELSE 'rh_lag' END || (p_size % 10) AS nm FROM part)""")
def f23(t):
    stem = F.when(F.col("p_partkey") % 3 == 0, "ratio_ma").when(F.col("p_partkey") % 3 == 1, "rh_ma").otherwise("rh_lag")
    nm = F.concat(stem, (F.col("p_size") % 10).cast("string"))
    return t.part.select("p_partkey", L.feature_family(nm).alias("family"), nm.endswith("4").alias("is_24"))


@query("f24_date_parts", "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, CAST(ts AS DATE) AS local_date FROM events")
def f24(t):
    parts = C.date_parts("ts")
    out = t.events.select("event_id", *[c.alias(n) for n, c in parts.items()])
    return out.withColumns({c: F.col(c).cast("long") for c in ("year", "month", "day", "hour")})


@query("f25_to_json", """SELECT series_id, ts, '{"series_id":"' || series_id || '","n":' || n || ',"yc":' || yc || '}' AS doc FROM met""")
def f25(t):
    return t.met().select("series_id", "ts", F.to_json(F.struct("series_id", "n", "yc")).alias("doc"))
