"""Fitted models stored under a fingerprint; a mismatch means a refit."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def fingerprint(**what) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:16]


def load_or_fit(spark: SparkSession, path: str, key: str, fit) -> tuple[DataFrame, bool]:
    """Models stored for ``key`` (and True), or those of ``fit()`` after appending them (and False)."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop):
        found = spark.read.parquet(path).where(F.col("fingerprint") == key)
        if not found.isEmpty():
            return found, True
    fit().withColumn("fingerprint", F.lit(key)).write.mode("append").partitionBy("fingerprint").parquet(path)
    return spark.read.parquet(path).where(F.col("fingerprint") == key), False
