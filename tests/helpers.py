import datetime as dt

import numpy as np
import pandas as pd

T0 = dt.datetime(2024, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=float(h))


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def series(spark, hours, values, key="a", name="x"):
    rows = [(key, at(h), None if v is None else float(v)) for h, v in zip(hours, values)]
    return spark.createDataFrame(rows, f"series_id STRING, ts TIMESTAMP_NTZ, {name} DOUBLE")


def forecasts(spark, y, p, thr=62.0, cut=None, key="a", hours=None):
    rows = [(key, at(h), None if a is None else float(a), None if b is None else float(b), thr, thr if cut is None else cut)
            for h, a, b in zip(hours or range(len(y)), y, p)]
    return spark.createDataFrame(rows, "series_id STRING, valid_ts TIMESTAMP_NTZ, y_true DOUBLE, y_pred DOUBLE, threshold DOUBLE, cut DOUBLE")


def random_features(spark, n=400, p=3, horizons=1, seed=0, gap=0.1, keys=1):
    """psi, labels with missing entries; also returned as NumPy."""
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p)) * np.arange(1, p + 1) + 5
    Y = X @ rng.normal(size=(p, horizons)) + rng.normal(size=(n, horizons)) + 3
    Y[rng.random(Y.shape) < gap] = np.nan
    key = np.array([f"k{i % keys}" for i in range(n)])
    pdf = pd.DataFrame({"model_id": key, "pos": range(n), "psi": list(X), "labels": list(Y)})
    rows = [(k, i, [float(v) for v in x], [None if np.isnan(v) else float(v) for v in y]) for k, i, x, y in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "model_id STRING, pos INT, psi ARRAY<DOUBLE>, labels ARRAY<DOUBLE>"), X, Y, key


def ridge_numpy(X, y, beta):
    """Independent reference: standardise on all rows, fit on labelled rows, intercept free."""
    mu, sd = X.mean(0), X.std(0)
    Z = np.column_stack([(X - mu) / sd, np.ones(len(X))])
    ok = np.isfinite(y)
    Z, y = Z[ok], y[ok]
    pen = np.eye(Z.shape[1])
    pen[-1, -1] = 0
    return np.linalg.solve(Z.T @ Z / len(y) + beta * pen, Z.T @ y / len(y))
