"""Series derived from the driver's tables, and the same derivations as SQL for the oracle.

Cell means use integer arithmetic (hundredths, integer division) so that thresholds,
ties and cuts are decided on identical numbers in every engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.calendar import add_hours, day_floor, hour_floor
from ..operators.chunks import complete_grid, windowed
from ..session import prepare

THRESHOLDS = (62.0, 67.0, 75.0)
HORIZONS = (24, 48, 72)
TRAIN_END = "2024-01-11 00:00:00"
VAL_END = "2024-01-21 00:00:00"


def ts_lit(text):
    return F.lit(text).cast("timestamp_ntz")


def split_of(ts, train_end=TRAIN_END, val_end=VAL_END):
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.when(t < ts_lit(train_end), "train").when(t < ts_lit(val_end), "val").otherwise("test")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def cells(self) -> DataFrame:
        """Hourly cells per event type: means in integer hundredths."""
        k = F.get_json_object("props", "$.k").cast("long")
        return (
            self.events.groupBy(F.col("event_type").alias("series_id"), hour_floor("ts").alias("ts"))
            .agg(F.count("*").alias("n"),
                 F.sum(F.round(F.col("value") * 100).cast("long")).alias("_v"),
                 F.sum(k).alias("_k"), F.sum(F.col("user_id") % 100).alias("_u"))
            .selectExpr("series_id", "ts", "n", "_v div n as xc", "(_k * 100) div n as kc", "(_u * 100) div n as uc")
        )

    def met(self) -> DataFrame:
        """Hourly weather-like drivers and a humidity-like target ``y``."""
        yc = F.expr("(kc + uc) div 2")
        return self.cells().select(
            "series_id", "ts", "n",
            (F.expr("xc div 4 - 1000") / 100.0).alias("t_c"),
            (F.col("kc") / 100.0).alias("rh"),
            F.when(F.col("n") % 3 == 0, F.col("xc") / 1000.0).otherwise(0.0).alias("rain"),
            (F.col("uc") / 10.0).alias("wind"),
            (F.lit(860.0) + F.col("uc") / 1000.0).alias("p_hpa"),
            yc.alias("yc"), (yc / 100.0).alias("y"),
        )

    def met_core(self) -> DataFrame:
        return self.met().select("series_id", "ts", "t_c", "rh", "y")

    def fc(self, horizons=HORIZONS) -> DataFrame:
        """Long forecast table of three simple models at several horizons."""
        met = self.met().select("series_id", "ts", "yc")
        origin = windowed(met, ["series_id"], lambda f: {"_s": f.total("yc", 24), "_c": f.count("yc", 24)}, back=24)
        clim = (met.where(F.col("ts") < ts_lit(TRAIN_END)).groupBy("series_id", F.hour("ts").alias("hod"))
                .agg(F.sum("yc").alias("_s"), F.count("*").alias("_c"))
                .selectExpr("series_id", "hod", "_s div _c as clim"))
        lead = origin.select(
            "series_id", F.col("ts").alias("origin_ts"), F.col("yc").alias("persistence"), F.expr("_s div _c as mean24"),
            F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_h"),
        ).withColumn("valid_ts", add_hours("origin_ts", "horizon_h")).withColumn("hod", F.hour("valid_ts"))
        truth = met.select("series_id", F.col("ts").alias("valid_ts"), F.col("yc").alias("_y"))
        rows = lead.join(truth, ["series_id", "valid_ts"]).join(clim, ["series_id", "hod"])
        stacked = F.explode(F.array(*[
            F.struct(F.lit(m).alias("model"), F.col(c).alias("p"))
            for m, c in (("persistence", "persistence"), ("mean24", "mean24"), ("climatology", "clim"))]))
        return rows.select("series_id", "horizon_h", "origin_ts", "valid_ts", "_y", stacked.alias("m")).select(
            "series_id", "m.model", "horizon_h", "origin_ts", "valid_ts", split_of("origin_ts").alias("split"),
            (F.col("_y") / 100.0).alias("y_true"), (F.col("m.p") / 100.0).alias("y_pred"))

    def fct(self, horizons=HORIZONS) -> DataFrame:
        """Forecasts times the alarm thresholds."""
        return self.fc(horizons).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))

    def ship(self) -> DataFrame:
        """Daily shipped quantity and mean price per supplier."""
        li = self.lineitem
        return (li.groupBy(F.col("l_suppkey").alias("series_id"), day_floor("l_shipdate").alias("ts"))
                .agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.count("*").alias("lines")))

    def depots(self) -> DataFrame:
        """Complete daily grid of 100 depots (suppliers modulo 100) with five weather-like drivers.

        Drivers are means per line (quantity, discount, tax) in whole tenths or hundredths, which do not grow with the
        number of lines; only ``rain`` counts lines. Days without a shipment are zero, so the series have no gaps.
        """
        li = self.lineitem
        cents = F.sum(F.round(F.col("l_discount") * 100).cast("long"))
        d = (li.groupBy((F.col("l_suppkey") % 100).alias("series_id"), day_floor("l_shipdate").alias("ts"))
             .agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("c"), cents.alias("d"),
                  F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("x")))
        g = complete_grid(d, ["series_id"], step_hours=24).na.fill(0, ["q", "c", "d", "x"])
        mean = {k: F.coalesce(F.expr(f"({k} * 100) div nullif(c, 0)"), F.lit(0)) for k in "qdx"}
        return g.select("series_id", "ts", (mean["q"] / 100.0).alias("t_c"), (mean["d"] / 10.0).alias("rh"), (F.col("c") / 10.0).alias("rain"),
                        (mean["x"] / 100.0).alias("wind"), (F.lit(860.0) + mean["x"] / 100.0).alias("p_hpa"), ((mean["q"] + mean["d"]) / 100.0).alias("y"))

    def sales(self) -> DataFrame:
        """Daily order count and turnover (in whole cents) per nation."""
        cust = self.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("series_id"))
        return (self.orders.join(cust, "o_custkey").groupBy("series_id", day_floor("o_orderdate").alias("ts"))
                .agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")))

    def ensembles(self) -> DataFrame:
        """Embedding vectors read as 64-member ensembles around 50, the label as truth."""
        return self.embeddings.select(
            "vec_id", F.transform("embedding", lambda v: F.round(v.cast("double") * 40 + 50, 4)).alias("members"),
            (F.lit(40.0) + F.col("label") * 5.0).alias("y"))


# The same derivations for the SQL oracle.
CTES = {
    "depot_days": """SELECT l_suppkey % 100 AS series_id, date_trunc('day', l_shipdate) AS ts, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS c,
        CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS BIGINT) AS d, CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS BIGINT) AS x FROM lineitem GROUP BY 1, 2""",
    "cells": """SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, count(*) AS n,
        CAST(sum(CAST(round(value*100) AS BIGINT)) // count(*) AS BIGINT) AS xc,
        CAST(sum(CAST(regexp_extract(props,'[0-9]+') AS BIGINT))*100 // count(*) AS BIGINT) AS kc,
        CAST(sum(user_id % 100)*100 // count(*) AS BIGINT) AS uc
        FROM events GROUP BY 1, 2""",
    "met": """SELECT series_id, ts, n, (xc // 4 - 1000) / 100e0 AS t_c, kc / 100e0 AS rh,
        CASE WHEN n % 3 = 0 THEN xc / 1000e0 ELSE 0e0 END AS rain, uc / 10e0 AS wind, 860e0 + uc / 1000e0 AS p_hpa,
        (kc + uc) // 2 AS yc, ((kc + uc) // 2) / 100e0 AS y FROM cells""",
    "grid": """SELECT g.series_id, g.ts, m.t_c, m.rh, m.y FROM
        (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM met GROUP BY 1) g
        LEFT JOIN met m USING (series_id, ts)""",
    "clim_hod": f"""SELECT series_id, hour(ts) AS hod, CAST(sum(yc) // count(*) AS BIGINT) AS clim FROM met
        WHERE ts < TIMESTAMP '{TRAIN_END}' GROUP BY 1, 2""",
    "orig": """SELECT series_id, ts AS origin_ts, yc, CAST(sum(yc) OVER w // count(*) OVER w AS BIGINT) AS mean24 FROM met
        WINDOW w AS (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)""",
    "fcw": """SELECT o.series_id, h.horizon_h, o.origin_ts, t.ts AS valid_ts, t.yc AS y_, o.yc AS p1, o.mean24 AS p2, c.clim AS p3
        FROM orig o CROSS JOIN (SELECT unnest([24, 48, 72]) AS horizon_h) h
        JOIN met t ON t.series_id = o.series_id AND t.ts = o.origin_ts + to_hours(h.horizon_h)
        JOIN clim_hod c ON c.series_id = o.series_id AND c.hod = hour(t.ts)""",
    "fc": f"""SELECT series_id, model, horizon_h, origin_ts, valid_ts,
        CASE WHEN origin_ts < TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN origin_ts < TIMESTAMP '{VAL_END}' THEN 'val' ELSE 'test' END AS split,
        y_ / 100e0 AS y_true, p / 100e0 AS y_pred FROM (
          SELECT *, 'persistence' AS model, p1 AS p FROM fcw UNION ALL
          SELECT *, 'mean24' AS model, p2 AS p FROM fcw UNION ALL
          SELECT *, 'climatology' AS model, p3 AS p FROM fcw)""",
    "fct": "SELECT fc.*, thr.threshold FROM fc CROSS JOIN (SELECT unnest([62e0, 67e0, 75e0]) AS threshold) thr",
    "ship": """SELECT l_suppkey AS series_id, date_trunc('day', l_shipdate) AS ts,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS lines FROM lineitem GROUP BY 1, 2""",
    "depots": """SELECT series_id, ts, q/100e0 AS t_c, d/10e0 AS rh, c/10e0 AS rain, x/100e0 AS wind, 860e0 + x/100e0 AS p_hpa, (q + d)/100e0 AS y FROM (
        SELECT g.series_id, g.ts, coalesce(q*100 // c, 0) AS q, coalesce(c, 0) AS c, coalesce(d*100 // c, 0) AS d, coalesce(x*100 // c, 0) AS x FROM
          (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM depot_days GROUP BY 1) g LEFT JOIN depot_days USING (series_id, ts))""",
    "sales": """SELECT c_nationkey AS series_id, date_trunc('day', o_orderdate) AS ts, count(*) AS n,
        CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS cents
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""",
    "ensembles": """SELECT vec_id, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE)*40 + 50, 4)) AS members,
        40e0 + label*5e0 AS y FROM embeddings""",
}


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the derivations it names, in dependency order."""
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(CTES[name])
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in need]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
