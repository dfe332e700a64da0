import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import at, frame, random_features, ridge_numpy, series
from tidemark.operators import features as X, linear as L
from tidemark.operators.moments import grams, standardise_vectors, triangular, vector_stats

M = ["model_id"]


def w_of(row):
    return np.array([*row["w"], row["b0"]])


@pytest.mark.parametrize("parts", [1, 5])
def test_l1_l2_ridge_per_key_and_horizon(spark, parts):
    d, X, Y, key = random_features(spark, horizons=3, keys=2)
    got = {(r["model_id"], r["horizon_h"]): r for r in L.fit_ridge(d.repartition(parts), M, (0, 24, 48), beta=0.5).collect()}
    for k in ("k0", "k1"):
        for i, h in enumerate((0, 24, 48)):
            m = key == k
            assert w_of(got[k, h]) == pytest.approx(ridge_numpy(X[m], Y[m, i], 0.5), rel=1e-8)
            assert got[k, h]["n"] == np.isfinite(Y[m, i]).sum()


def test_l1_matches_mllib(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    d, X, Y, _ = random_features(spark, gap=0.0)
    ours = L.fit_ridge(d, M, (0,), beta=0.5).first()
    y = Y[:, 0]
    lr = LinearRegression(solver="normal", elasticNetParam=0.0, regParam=0.5 * y.std(), standardization=True)
    theirs = lr.fit(d.select(array_to_vector("psi").alias("features"), F.get("labels", F.lit(0)).alias("label")))
    assert np.array(ours["w_raw"]) == pytest.approx(np.array(theirs.coefficients), rel=0.01)  # MLlib uses sample deviations


def test_l5_score(spark):
    d, X, Y, _ = random_features(spark)
    m = L.fit_ridge(d, M, (0,), beta=0.1)
    w = ridge_numpy(X, Y[:, 0], 0.1)
    want = np.column_stack([(X - X.mean(0)) / X.std(0), np.ones(len(X))]) @ w
    got = L.score(d, m, M).orderBy("pos").toPandas()["y_pred"]
    assert got.to_numpy() == pytest.approx(want)


def asymmetric(spark, kind, taus):
    rng = np.random.default_rng(2)
    y = rng.exponential(size=20_000)
    pdf = [([float(v)], [float(t)]) for v, t in zip(rng.normal(size=len(y)), y)]
    d = frame(spark, "psi ARRAY<DOUBLE>, labels ARRAY<DOUBLE>", pdf)
    models = L.fit_reweighted(d, (0,), taus, beta=100.0, kind=kind, max_iter=60).collect()
    return y, {r["tau"]: r["b0"] for r in models}


def test_l3_expectile(spark):
    y, b = asymmetric(spark, "expectile", (0.9,))
    e = b[0.9]
    up, down = np.maximum(y - e, 0).sum(), np.maximum(e - y, 0).sum()
    assert 0.9 * up == pytest.approx(0.1 * down, rel=1e-3) and e == pytest.approx(2.04, abs=0.06)


def test_l4_quantile(spark):
    y, b = asymmetric(spark, "quantile", (0.9,))
    assert (y < b[0.9]).mean() == pytest.approx(0.9, abs=0.01)


def test_l6_select_beta(spark):
    d, X, Y, _ = random_features(spark)
    d = d.withColumn("split", F.when(F.col("pos") < 250, "train").otherwise("val"))
    rows = L.select_beta(d, M, (0,), (0.01, 1.0)).collect()
    mu, sd = X[:250].mean(0), X[:250].std(0)
    for r in rows:
        w = ridge_numpy(X[:250], Y[:250, 0], r["beta"])
        v = np.isfinite(Y[250:, 0])
        yv = Y[250:, 0][v]
        p = (np.column_stack([(X[250:] - mu) / sd, np.ones(150)]) @ w)[v]
        assert r["val_r2"] == pytest.approx(1 - ((yv - p) ** 2).sum() / ((yv - yv.mean()) ** 2).sum())
    best = max(rows, key=lambda r: r["val_r2"])["beta"]
    assert {r["best_beta"] for r in rows} == {best}


@pytest.mark.parametrize("parts", [1, 9])
def test_l7_qr_ridge(spark, parts):
    d, X, Y, _ = random_features(spark, gap=0.0)
    d = d.withColumn("y", F.get("labels", F.lit(0))).repartition(parts)
    got = L.ridge_by_qr(d, M, 0.3).first()
    assert w_of(got) == pytest.approx(ridge_numpy(X, Y[:, 0], 0.3), rel=1e-8)


def test_l7_tree_keeps_the_gram(spark):
    d, X, Y, _ = random_features(spark, gap=0.0)
    rows = triangular(d.withColumn("y", F.get("labels", F.lit(0))).repartition(7), M, "psi", "y", fan_in=2).orderBy("i").collect()
    R = np.vstack([r["g"] for r in rows])
    A = np.column_stack([X, np.ones(len(X)), Y[:, 0]])
    assert R.T @ R == pytest.approx(A.T @ A)


def test_l8_hour_ridge(spark):
    d, X, Y, _ = random_features(spark, gap=0.0)
    got = L.fit_ridge(d, M, (0,), beta=1.0, penalise_intercept=True, normalise=False).first()
    Z = np.column_stack([(X - X.mean(0)) / X.std(0), np.ones(len(X))])
    assert w_of(got) == pytest.approx(np.linalg.solve(Z.T @ Z + np.eye(4), Z.T @ Y[:, 0]))


def ar_series(spark, n=300, gap=()):
    rng = np.random.default_rng(4)
    x = rng.normal(size=n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.8 * y[t - 1] + 0.5 * x[max(t - 3, 0)] + 1.0
    rows = [("a", at(t), float(x[t]), float(y[t])) for t in range(n) if t not in gap]
    return frame(spark, "series_id STRING, ts TIMESTAMP_NTZ, x DOUBLE, y DOUBLE", rows), x, y


def test_l10_recovers_coefficients(spark):
    d, _, _ = ar_series(spark)
    c = L.autoregressive(d, ["series_id"], "x", "y", 3).first()
    assert (c["a"], c["b"], c["c"]) == pytest.approx((0.8, 0.5, 1.0))


def test_l11_reanchored_paths(spark):
    d, x, y = ar_series(spark, gap={100})
    coef = frame(spark, "series_id STRING, a DOUBLE, b DOUBLE, c DOUBLE", [("a", 0.7, 0.4, 0.9)])

    def roll(start, t0, steps):
        v = start
        for j in range(1, steps + 1):
            v = 0.7 * v + 0.4 * x[t0 + j - 3] + 0.9
        return v

    for rebase in (None, 24):
        got = {r["ts"]: r for r in L.transfer_reanchored(d, coef, ["series_id"], "x", "y", 6, 3, rebase).collect()}
        assert len(got) > 200
        for t in (50, 71, 200):
            t0 = t if rebase is None else t // 24 * 24
            assert got[at(t)]["y_pred"] == pytest.approx(roll(y[t0], t0, t + 6 - t0))
        assert at(99) not in got  # the path crosses the gap
        assert at(94) not in got  # the truth is missing


@pytest.mark.parametrize("chunk", [10, 24 * 366])
def test_l12_recursive_rollout(spark, chunk):
    d, x, y = ar_series(spark)
    coef = frame(spark, "series_id STRING, a DOUBLE, b DOUBLE, c DOUBLE", [("a", 0.9, 0.4, 0.1)])
    got = L.recursive_rollout(d, coef, ["series_id"], "x", "y", chunk).orderBy("ts").toPandas()["y_pred"].to_numpy()
    s, want = y[0], []
    for v in x:
        s = 0.9 * s + 0.4 * v + 0.1
        want.append(s)
    assert got == pytest.approx(np.array(want))


def chain(spark, n=400):
    rng = np.random.default_rng(6)
    K = np.array([[0.9, -0.2], [0.2, 0.9]])
    z = np.zeros((n, 2))
    for t in range(1, n):
        z[t] = K @ z[t - 1] + rng.normal(size=2)
    y = z @ [1.0, 2.0] + 5
    rows = [("a", at(t), [float(v) for v in z[t]], [float(y[t])]) for t in range(n)]
    return frame(spark, "series_id STRING, ts TIMESTAMP_NTZ, psi ARRAY<DOUBLE>, labels ARRAY<DOUBLE>", rows), z, y


def operator_numpy(z, y, beta):
    Z = (z - z.mean(0)) / z.std(0)
    A, B = Z[:-1], Z[1:]
    K = np.linalg.solve(A.T @ A / len(A) + beta * np.eye(2), A.T @ B / len(A)).T
    return K, ridge_numpy(z, y, beta)


def test_l14_rollout_weights(spark):
    d, z, y = chain(spark)
    K, w = operator_numpy(z, y, 0.1)
    for r in L.fit_transition(d, ["series_id"], (1, 6), beta=0.1).collect():
        want = w[:-1] @ np.linalg.matrix_power(K, r["horizon_h"])
        assert np.array(r["w"]) == pytest.approx(want, rel=1e-6)


def test_l15_modes(spark):
    d, z, y = chain(spark)
    K, _ = operator_numpy(z, y, 1e-6)
    ev = np.linalg.eigvals(K)
    rows = L.mode_table(d, ["series_id"], beta=1e-6).collect()
    assert sorted(r["abs_lambda"] for r in rows) == pytest.approx(sorted(np.abs(ev)), rel=1e-6)
    assert rows[0]["period_hours"] == pytest.approx(2 * np.pi / abs(np.angle(ev[0])), rel=1e-6)
    assert rows[0]["tau_hours"] == pytest.approx(-1 / np.log(abs(ev[0])), rel=1e-6)


def test_moments_do_not_depend_on_the_memory_limit(spark):
    d, X, Y, key = random_features(spark, keys=5)
    stats = vector_stats(d, M)
    z = standardise_vectors(d, stats, M)
    a = grams(z, M).orderBy("model_id", "h", "i").collect()
    b = grams(z, M, max_bytes=1).orderBy("model_id", "h", "i").collect()
    assert [r["g"] for r in a] == [pytest.approx(r["g"]) for r in b]


def test_affine_scan_is_the_recursion():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=1000) * 0.9, rng.normal(size=1000)
    A, B = L.affine_scan(a, b)
    x, want = 1.7, []
    for u, v in zip(a, b):
        x = u * x + v
        want.append(x)
    assert A * 1.7 + B == pytest.approx(want) and [len(v) for v in L.affine_scan([], [])] == [0, 0]


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_pairs_meet_inside_their_blocks(spark, chunk):
    rng = np.random.default_rng(5)
    hours = [h for h in range(120) if h % 17]
    Z = rng.normal(size=(len(hours), 3)) + 4
    d = frame(spark, "series_id STRING, ts TIMESTAMP_NTZ, psi ARRAY<DOUBLE>, labels ARRAY<DOUBLE>",
              [("a", at(h), [float(v) for v in z], [None if h % 5 == 0 else float(z.sum()), 1.0]) for h, z in zip(hours, Z)])
    got = {}
    for r in X.pair_moments(d, ["series_id"], chunk=chunk).collect():
        got.setdefault(r.h, {})[r.i] = r.g
    A = np.column_stack([Z, np.ones(len(Z))])
    i = np.array([k for k in range(len(hours) - 1) if hours[k + 1] == hours[k] + 1])
    for code, want in ((-1, A.T @ A), (X.PAIRS, A[i].T @ A[i]), (X.CROSS, A[i].T @ A[i + 1])):
        assert np.vstack([got[code][k] for k in range(4)]) == pytest.approx(want)
