"""Interim readers and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.clean import keep_first


def read_interim(spark: SparkSession, path: str, schema: str, keys=("series_id", "ts")) -> DataFrame:
    """CSV files with an explicit schema; one row per key, first by (file, position in file)."""
    raw = spark.read.csv(path, schema=schema, header=True)
    tagged = raw.withColumn("_file", F.input_file_name()).withColumn("_pos", F.monotonically_increasing_id())
    return keep_first(tagged, list(keys), ["_file", "_pos"]).drop("_file", "_pos")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str, by_year_of=None) -> None:
    """Parquet; partitioned by year so that period filters prune files."""
    w = df.withColumn("year", F.year(by_year_of)).write.partitionBy("year") if by_year_of else df.write
    w.mode("errorifexists").parquet(path)


def summary_json(df: DataFrame, keys, label, values) -> DataFrame:
    """One JSON text per key: {label: {metric: value}}. Labels per key are few (models, arms)."""
    entry = F.struct(F.col(label).alias("key"), F.struct(*values).alias("value"))
    return df.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("summary"))


def dashboard_rows(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Compact extract: only the named columns, rounded."""
    return df.select(*[F.round(c, d).alias(c) if d is not None else F.col(c) for c, d in digits.items()])
