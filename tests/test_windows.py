import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import at, frame, series
from tidemark.operators import clean, features as X
from tidemark.operators.chunks import complete_grid, positions, windowed

K = ["series_id"]


def column(df, c):
    return [r[c] for r in df.orderBy("ts").collect()]


def test_ma_expanding_and_strict(spark):
    d = series(spark, range(4), [1, 2, None, 4])
    assert column(X.causal_means(d, K, ["x"], (2,)), "x_ma2") == [1.0, 1.5, 2.0, 4.0]
    assert column(X.causal_means(d, K, ["x"], (2,), strict=True), "x_ma2") == [None, 1.5, None, None]


def test_lag_gap_is_by_time(spark):
    d = series(spark, [0, 1, 3], [10, 11, 13])
    assert column(windowed(d, K, lambda f: {"l": f.at("x", -1)}, back=1), "l") == [None, 10.0, None]


def test_full_lag_windows_only(spark):
    d = series(spark, [0, 1, 2, 4, 5, 6], range(6))
    spec = X.FeatureSpec(drivers=("x",), lags=3, windows=(), slow=False, ratio=False)
    f = X.build_features(d, K, spec).orderBy("ts").collect()
    assert [r["psi"] for r in f] == [[2.0, 1.0, 0.0], [5.0, 4.0, 3.0]]


def wavy(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    hours = [h for h in range(n) if rng.random() > 0.1]
    return series(spark, hours, rng.normal(size=len(hours)))


@pytest.mark.parametrize("chunk", [24, 31, 1000])
def test_chunks_do_not_change_results(spark, chunk):
    d = wavy(spark)

    def run(c):
        m = X.causal_means(d, K, ["x"], (3, 24), chunk=c)
        lead = X.target_leads(m, K, "x", (0, 5, 24), chunk=c)
        return [(r["ts"], round(r["x_ma3"], 9), round(r["x_ma24"], 9), tuple(r["labels"])) for r in lead.orderBy("ts").collect()]

    assert run(chunk) == run(100_000)


def test_partitioning_does_not_change_results(spark):
    d = wavy(spark)
    a, b = [column(X.causal_means(d.repartition(n), K, ["x"], (24,)), "x_ma24") for n in (1, 7)]
    assert a == pytest.approx(b)


def test_causality(spark):
    d = wavy(spark)
    changed = d.withColumn("x", F.when(F.col("ts") > F.lit(at(300)).cast("timestamp_ntz"), F.col("x") * 100).otherwise(F.col("x")))
    spec = X.FeatureSpec(drivers=("x",), lags=4, windows=(24,), ratio=False, mean_of=("x",))

    def before(df):
        f = X.build_features(df, K, spec)
        return [tuple(np.round(r["psi"], 9)) for r in f.where(F.col("ts") <= F.lit(at(300)).cast("timestamp_ntz")).orderBy("ts").collect()]

    assert before(d) == before(changed) and len(before(d)) > 50


def test_positions_across_chunks(spark):
    d = wavy(spark)
    got = positions(d, K, chunk=24).orderBy("ts").collect()
    assert [r["pos"] for r in got] == list(range(len(got))) and got[0]["n_rows"] == len(got)


def test_complete_grid(spark):
    g = complete_grid(series(spark, [0, 2, 5], [1, 2, 3]), K)
    assert column(g, "x") == [1.0, None, 2.0, None, None, 3.0]


def test_stride_split(spark):
    d = series(spark, range(10), range(10))
    s = clean.split_by_fraction(d, K)
    assert column(s, "split") == ["train"] * 6 + ["val"] * 2 + ["test"] * 2
    assert column(clean.stride(d, K, 3), "x") == [0.0, 3.0, 6.0, 9.0]


def test_nan_guard(spark):
    d = frame(spark, "a DOUBLE, b DOUBLE", [(1.0, float("nan")), (1.0, 2.0), (None, 1.0)])
    assert clean.paired(d, "a", "b").count() == 1
    assert clean.nan_to_null(d).where("b IS NULL").count() == 1


def test_keep_first_combines_before_the_shuffle(spark):
    d = spark.range(10_000).selectExpr("'hot' AS k", "id AS o", "id * 2 AS v")
    out = clean.keep_first(d, ["k"], ["o"])
    assert out.collect()[0]["v"] == 0
    plan = out._jdf.queryExecution().explainString(out.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "partial_min_by" in plan and "Window" not in plan


def test_w10_pooled_scale(spark):
    d = series(spark, range(50), range(50))
    r = X.standardiser(d, [], ["x"]).first()
    assert r["mu_x"] == pytest.approx(24.5) and r["sd_x"] == pytest.approx(np.arange(50).std())


def test_w13_spliced_window_equals_lag_vector(spark):
    d = frame(spark, "h ARRAY<ARRAY<DOUBLE>>, g ARRAY<ARRAY<DOUBLE>>", [([[1.0], [2.0], [3.0]], [[4.0], [5.0]])])
    got = X.splice_windows(d, F.col("h"), F.col("g"), 2, 3).orderBy("step").collect()
    assert [r["window"] for r in got] == [[4.0, 3.0, 2.0], [5.0, 4.0, 3.0]]
