"""Executed plans: no product of tables, and the features are never the side that is sent."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import QUERIES
from tidemark.plans.series import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["l5_score", "l19_lag_order_check", "o3_window_ranking", "m24_acceptance", "m29_family_importance"])
def test_no_product_and_features_stay(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2048")
    try:
        df = QUERIES[name](spark, SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin BuildLeft" not in plan


class TenFold(Tables):
    def __getattr__(self, name):
        df = super().__getattr__(name)
        return df.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("_k") if name == "lineitem" else df


def test_drivers_do_not_saturate(spark):
    """Ten times the lines leave the drivers that are means as they are, and none of them constant."""
    one, ten = Tables(spark, SMALL).depots(), TenFold(spark, SMALL).depots()
    spread = [F.stddev(c).alias(c) for c in ("t_c", "rh", "wind", "y", "rain")]
    a, b = one.agg(*spread).first(), ten.agg(*spread).first()
    assert all(b[c] == pytest.approx(a[c]) and b[c] > 0 for c in ("t_c", "rh", "wind", "y")) and b.rain == pytest.approx(10 * a.rain)
