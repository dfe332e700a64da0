"""Hourly weather payloads: nested JSON maps to a wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: missing marker of the public weather service.
FILL = -999.0
DRIVERS = ("T2M", "T2MDEW", "RH2M", "PRECTOTCORR", "WS10M", "WS2M", "WD10M", "PS", "ALLSKY_SFC_SW_DWN")
PAYLOAD = "properties STRUCT<parameter: MAP<STRING, MAP<STRING, DOUBLE>>>"


def parse_weather(df: DataFrame, text="value", keys=("series_id",), variables=DRIVERS) -> DataFrame:
    """Rows ``(keys, ts, <variables>)``. A payload without parameters fails the job."""
    par = F.from_json(text, PAYLOAD)["properties"]["parameter"]
    checked = F.when(F.coalesce(F.size(par), F.lit(0)) > 0, par).otherwise(
        F.raise_error(F.lit("weather payload without parameters")).cast("map<string,map<string,double>>"))
    long = (df.select(*keys, F.explode(checked).alias("variable", "hours"))
            .where(F.col("variable").isin(*variables))
            .select(*keys, "variable", F.explode("hours").alias("_k", "_v")))
    ts = F.to_timestamp_ntz("_k", F.lit("yyyyMMddHH"))
    value = F.nullif(F.col("_v"), F.lit(FILL))
    return long.groupBy(*keys, ts.alias("ts")).agg(
        *[F.max(F.when(F.col("variable") == v, value)).alias(v) for v in variables])


def read_weather(spark: SparkSession, path: str, variables=DRIVERS) -> DataFrame:
    """One JSON document per file (a site-year); the site is the file's folder name."""
    raw = spark.read.text(path, wholetext=True)
    site = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return parse_weather(raw.withColumn("series_id", site), "value", ["series_id"], variables)
