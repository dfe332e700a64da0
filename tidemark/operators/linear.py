"""Linear readouts per horizon: ridge, expectile, quantile, first-order and rollout models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import add_hours
from ..functions.labels import feature_family
from ..session import stage
from .chunks import windowed
from .features import CROSS, PAIRS, pair_moments
from .moments import MODEL_BYTES, grams, standardise_vectors, triangular, unpack, vector_stats, weighted_grams


def ridge(G, b, n, beta, penalise_intercept=False, normalise=True):
    """Solve ``(G/n + beta*I) w = b/n``; the last entry is the intercept."""
    pen = np.eye(len(G))
    if not penalise_intercept:
        pen[-1, -1] = 0.0
    s = n if normalise else 1.0
    return np.linalg.solve(G / s + beta * pen, b / s)


def _types(df, keys):
    t = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"{k} {t[k]}" for k in keys)


def _raw(models: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Fold the standardisation into the weights: ``y = b0 + w_raw . psi``."""
    j = models.join(stats.select(*keys, "mu", "sigma"), list(keys))
    w_raw = F.zip_with("w", "sigma", lambda w, s: w / s)
    shift = F.aggregate(F.zip_with(w_raw, "mu", lambda w, m: w * m), F.lit(0.0), lambda a, v: a + v)
    return j.withColumn("w_raw", w_raw).withColumn("b_raw", F.col("b0") - shift)


def prepare(feats: DataFrame, keys, train=None):
    """Standardisation from the training rows, applied to all rows."""
    stats = stage(vector_stats(feats.where(train) if train is not None else feats, keys))
    return standardise_vectors(feats, stats, keys), stats


def standardised(G):
    """Mean and deviation held in a moment matrix of ``[psi, 1]``, and the map of moments to that scale."""
    def scaled(S, mu, sigma):
        T = np.diag(np.append(1.0 / sigma, 1.0))
        T[-1, :-1] = -mu / sigma
        return T.T @ S[0] @ T, T.T @ S[1]

    n = G[-1, -1]
    mu = G[-1, :-1] / n
    var = np.diag(G)[:-1] / n - mu * mu
    # A constant column leaves only rounding noise in var.
    sigma = np.sqrt(np.where(var > 1e-12 * np.maximum(mu * mu, 1e-12), var, 1.0))
    return mu, sigma, lambda S: scaled(S, mu, sigma)


def fit_ridge(feats: DataFrame, keys, horizons, beta=0.5, penalise_intercept=False, normalise=True) -> DataFrame:
    """One weight vector per (key, horizon) from a single pass over the training rows.

    ``feats`` holds ``psi`` and ``labels`` (one entry per horizon). Means and deviations come from
    the same moment matrix, so the features are read once and never standardised row by row.
    """
    return solve_ridge(grams(feats, keys, z="psi"), keys, horizons, beta, penalise_intercept, normalise)


def solve_ridge(g: DataFrame, keys, horizons, beta=0.5, penalise_intercept=False, normalise=True) -> DataFrame:
    """The same from moment rows."""

    def solve(pdf):
        key = {k: pdf[k].iloc[0] for k in keys}
        shared = np.vstack(pdf[pdf["h"] == -1].sort_values("i")["g"].to_list())
        mu, sigma, scale = standardised(shared)
        rows = []
        for h, (G, b, _) in zip(horizons, unpack(pdf, len(horizons))):
            n = G[-1, -1]
            if n < 2:
                continue
            G, b = scale((G, b))
            w = ridge(G, b, n, beta, penalise_intercept, normalise)
            raw = w[:-1] / sigma
            rows.append({**key, "horizon_h": h, "beta": beta, "n": int(round(n)), "mu": mu, "sigma": sigma, "w": w[:-1], "b0": float(w[-1]),
                         "w_raw": raw, "b_raw": float(w[-1] - raw @ mu)})
        return pd.DataFrame(rows, columns=[*keys, "horizon_h", "beta", "n", "mu", "sigma", "w", "b0", "w_raw", "b_raw"])

    schema = (f"{_types(g, keys)}, horizon_h INT, beta DOUBLE, n LONG, mu ARRAY<DOUBLE>, sigma ARRAY<DOUBLE>, w ARRAY<DOUBLE>, b0 DOUBLE, "
              "w_raw ARRAY<DOUBLE>, b_raw DOUBLE")
    return g.groupBy(*keys).applyInPandas(solve, schema)


def small_side(models: DataFrame, psi="w_raw") -> DataFrame:
    """The models as the side that is sent, after a check of their size; larger ones are joined by shuffle on their keys.

    A key that is the same literal on all rows is no join key to the optimizer, and the features would then be sent.
    """
    models = stage(models)
    size = models.agg(F.sum(F.size(psi)) * 24).first()[0] or 0
    return F.broadcast(models) if size <= MODEL_BYTES else models


def score(feats: DataFrame, models: DataFrame, keys, psi="psi", clip=None, carry=()) -> DataFrame:
    """``y_pred`` for every (row, model) pair of a key: an equi-join and a dot product in the JVM."""
    dot = F.aggregate(F.zip_with(psi, "w_raw", lambda a, b: a * b), F.col("b_raw"), lambda a, v: a + v)
    if clip:
        dot = F.greatest(F.least(dot, F.lit(float(clip[1]))), F.lit(float(clip[0])))
    return feats.join(small_side(models), list(keys)).withColumn("y_pred", dot).drop("w", "b0", "w_raw", "b_raw", "mu", "sigma", "psi", *carry)


def select_beta(feats: DataFrame, keys, horizons, betas, split="split") -> DataFrame:
    """Validation R2 for every beta from the train and val moments: no pass per beta."""
    z, _ = prepare(feats, keys, F.col(split) == "train")
    g = grams(z.where(F.col(split).isin("train", "val")), [*keys, split])

    def solve(pdf):
        key = {k: pdf[k].iloc[0] for k in keys}
        part = {s: unpack(d, len(horizons)) for s, d in pdf.groupby(split)}
        rows = []
        for i, h in enumerate(horizons):
            G, b, _ = part["train"][i]
            Gv, bv, yy = part["val"][i]
            nv = Gv[-1, -1]
            sst = yy - bv[-1] ** 2 / nv
            for beta in betas:
                w = ridge(G, b, G[-1, -1], beta)
                sse = w @ Gv @ w - 2 * w @ bv + yy
                rows.append({**key, "horizon_h": h, "beta": float(beta), "val_r2": float(1 - sse / sst)})
        return pd.DataFrame(rows)

    out = g.groupBy(*keys).applyInPandas(solve, f"{_types(feats, keys)}, horizon_h INT, beta DOUBLE, val_r2 DOUBLE")
    best = F.max_by("beta", F.struct(F.col("val_r2"), -F.col("beta"))).alias("best_beta")
    return out.join(out.groupBy(*keys, "horizon_h").agg(best), [*keys, "horizon_h"])


def fit_and_test(feats: DataFrame, keys, horizons, beta=0.5, split="split") -> DataFrame:
    """Ridge readouts from the train part and their R2 on the test part, both from one pass of moments."""
    return solve_and_test(grams(feats.where(F.col(split).isin("train", "test")), [*keys, split], z="psi"), keys, horizons, beta, split)


def solve_and_test(g: DataFrame, keys, horizons, beta=0.5, split="split") -> DataFrame:
    """The same from moment rows of ``[*keys, split]``."""

    def solve(pdf):
        part = {s: d for s, d in pdf.groupby(split)}
        if len(part) < 2:
            return pd.DataFrame(columns=[*keys, *names])
        mu, sigma, scale = standardised(np.vstack(part["train"][part["train"]["h"] == -1].sort_values("i")["g"].to_list()))
        rows = []
        for h, (G, b, _), (Gt, bt, yy) in zip(horizons, unpack(part["train"], len(horizons)), unpack(part["test"], len(horizons))):
            n, m = G[-1, -1], Gt[-1, -1]
            if n < 2 or m < 2:
                continue
            w = ridge(*scale((G, b)), n, beta)
            Gt, bt = scale((Gt, bt))
            spread = yy - bt[-1] ** 2 / m
            r2 = 1 - (w @ Gt @ w - 2 * w @ bt + yy) / spread if spread > 0 else np.nan
            rows.append({**{k: pdf[k].iloc[0] for k in keys}, "horizon_h": h, "n": int(round(n)), "n_test": int(round(m)), "w": w[:-1], "b0": float(w[-1]), "test_r2": r2})
        return pd.DataFrame(rows, columns=[*keys, *names])

    names = ["horizon_h", "n", "n_test", "w", "b0", "test_r2"]
    schema = f"{_types(g, keys)}, horizon_h INT, n LONG, n_test LONG, w ARRAY<DOUBLE>, b0 DOUBLE, test_r2 DOUBLE"
    return g.groupBy(*keys).applyInPandas(solve, schema)


def ridge_by_qr(feats: DataFrame, keys, beta, y="y", weight=None) -> DataFrame:
    """Ridge through stacked QR factors: keeps digits that the normal equations lose on collinear lags."""
    z, stats = prepare(feats, keys)
    r = triangular(z, keys, "z", y, weight)
    n = feats.groupBy(*keys).agg(F.count(y).alias("n"))

    def solve(pdf):
        R = np.vstack(pdf.sort_values("i")["g"].to_list())
        cnt = float(pdf["n"].iloc[0])
        p = R.shape[1] - 2
        A, b = R[:, :-1] / np.sqrt(cnt), R[:, -1] / np.sqrt(cnt)
        pen = np.sqrt(beta) * np.eye(p + 1)[:p]
        w, *_ = np.linalg.lstsq(np.vstack([A, pen]), np.concatenate([b, np.zeros(p)]), rcond=None)
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**row, "horizon_h": 0, "beta": float(beta), "n": int(cnt), "w": w[:-1], "b0": float(w[-1]),
                              "condition": float(np.linalg.cond(A))}])

    schema = f"{_types(feats, keys)}, horizon_h INT, beta DOUBLE, n LONG, w ARRAY<DOUBLE>, b0 DOUBLE, condition DOUBLE"
    return _raw(r.join(n, list(keys)).groupBy(*keys).applyInPandas(solve, schema), stats, keys)


def fit_reweighted(feats: DataFrame, horizons, taus, beta=0.5, kind="expectile", max_iter=25, tol=1e-7, eps=1e-3) -> DataFrame:
    """Asymmetric readouts by iterative reweighting: ``expectile`` or true ``quantile``.

    All (horizon, tau) pairs share each pass over the staged vectors; between passes only
    their weight vectors travel (a few arrays, fixed by the arguments).
    """
    keys = ["model_id"]
    feats = feats.withColumn("model_id", F.lit(kind))
    z, stats = prepare(feats, keys)
    z = stage(z.select("model_id", "z", "labels"))
    sets = [(h, tau) for h in range(len(horizons)) for tau in taus]
    W, live, steps = None, np.arange(len(sets)), np.zeros(len(sets), int)
    for done in range(max_iter + 1):  # the unweighted start, then max_iter reweighted solves; a set leaves the passes when it has converged
        def weigh(A, Y, W=W, live=live):
            for s in live:
                h, tau = sets[s]
                r = np.zeros(len(A)) if W is None else Y[:, h] - A @ W[s]
                w = np.ones(len(A)) if W is None else np.where(r > 0, tau, 1 - tau)
                if W is not None and kind == "quantile":
                    w = w / np.maximum(np.abs(r), eps)
                yield h, w

        def solve(pdf):
            rows = []
            for s, d in pdf.groupby("h"):
                M = np.vstack(d.sort_values("i")["g"].to_list())
                w = ridge(M[:-1, :-1], M[:-1, -1], M[-2, -2], beta)
                rows.append({"s": int(s), "n": float(M[-2, -2]), "w": w})
            return pd.DataFrame(rows)

        g = weighted_grams(z, keys, weigh, len(live))
        # At most len(horizons) * len(taus) small vectors come back.
        new = g.groupBy(*keys).applyInPandas(solve, "s INT, n DOUBLE, w ARRAY<DOUBLE>").toPandas().sort_values("s")
        nxt = np.vstack(new["w"].to_list())
        moved = np.full(len(live), np.inf) if W is None else np.abs(nxt - W[live]).max(axis=1)
        W = nxt if W is None else W
        W[live], steps[live] = nxt, done
        live = live[moved >= tol]
        if not len(live):
            break
    spark = feats.sparkSession
    rows = [(kind, horizons[h], float(tau), float(beta), [float(v) for v in W[s][:-1]], float(W[s][-1]), int(steps[s]), s not in live) for s, (h, tau) in enumerate(sets)]
    models = spark.createDataFrame(rows, "model_id STRING, horizon_h INT, tau DOUBLE, beta DOUBLE, w ARRAY<DOUBLE>, b0 DOUBLE, iterations INT, converged BOOLEAN")
    return _raw(models, stats, keys)


# ---- first-order transfer ----------------------------------------------------------------

def first_order(df: DataFrame, keys, x, y, lags, split="split", ts="ts") -> DataFrame:
    """``y(t) = a x(t-lag) + b`` on train for each lag, validation R2, best lag (smaller wins ties)."""
    wide = windowed(df, keys, lambda f: {f"_x{k}": f.at(x, -k) for k in lags}, ts, back=max([1, *lags]))
    pairs = wide.select(*keys, split, F.col(y).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag_h"), F.col(f"_x{k}").alias("x")) for k in lags])).alias("_p"))
    pairs = pairs.select(*keys, split, "_y", "_p.lag_h", F.col("_p.x").alias("_x")).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    tr, va = F.col(split) == "train", F.col(split) == "val"

    def on(cond, c):
        return F.when(cond, F.col(c))

    # One aggregation: the fit from train moments, the validation error from val moments.
    m = pairs.groupBy(*keys, "lag_h").agg(
        F.regr_slope(on(tr, "_y"), on(tr, "_x")).alias("a"), F.regr_intercept(on(tr, "_y"), on(tr, "_x")).alias("b"),
        F.avg(on(va, "_x")).alias("mx"), F.avg(on(va, "_y")).alias("my"), F.var_pop(on(va, "_x")).alias("vx"),
        F.var_pop(on(va, "_y")).alias("vy"), F.covar_pop(on(va, "_x"), on(va, "_y")).alias("cxy"))
    bias = F.col("my") - F.col("a") * F.col("mx") - F.col("b")
    mse = F.col("vy") - 2 * F.col("a") * F.col("cxy") + F.col("a") * F.col("a") * F.col("vx") + bias * bias
    m = m.select(*keys, "lag_h", "a", "b", (1 - mse / F.nullif("vy", F.lit(0.0))).alias("val_r2"))
    best = m.groupBy(*keys).agg(F.min_by("lag_h", F.struct(-F.round("val_r2", 9), F.col("lag_h"))).alias("best_lag"))
    return m.join(best, list(keys))


def autoregressive(df: DataFrame, keys, x, y, lag=3, ts="ts") -> DataFrame:
    """``y(t) = a y(t-1) + b x(t-lag) + c`` by least squares from grouped covariances; ``a`` is the pole."""
    w = windowed(df, keys, lambda f: {"_u": f.at(y, -1), "_v": f.at(x, -lag)}, ts, back=max(1, lag))
    w = w.where(F.col("_u").isNotNull() & F.col("_v").isNotNull() & F.col(y).isNotNull())
    m = w.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y).alias("my"), F.avg("_u").alias("mu_"), F.avg("_v").alias("mv"), F.var_pop("_u").alias("uu"),
        F.var_pop("_v").alias("vv"), F.covar_pop("_u", "_v").alias("uv"), F.covar_pop(y, "_u").alias("yu"), F.covar_pop(y, "_v").alias("yv"))
    det = F.nullif(F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv"), F.lit(0.0))
    a = (F.col("yu") * F.col("vv") - F.col("yv") * F.col("uv")) / det
    b = (F.col("yv") * F.col("uu") - F.col("yu") * F.col("uv")) / det
    m = m.withColumn("a", a).withColumn("b", b)
    return m.select(*keys, "n", "a", "b", (F.col("my") - F.col("a") * F.col("mu_") - F.col("b") * F.col("mv")).alias("c"), F.lit(lag).alias("lag_h"))


def transfer_direct(df: DataFrame, coef: DataFrame, keys, x, y, horizon, lag=3, ts="ts") -> DataFrame:
    """Direct use with the measured origin: ``a y(t) + b x(t+h-lag) + c``. Uses the future driver when h > lag."""
    w = windowed(df, keys, lambda f: {"_x": f.at(x, horizon - lag), "y_true": f.at(y, horizon)}, ts, back=max(0, lag - horizon) + 1, ahead=horizon)
    j = w.join(coef, list(keys))
    return j.select(*keys, ts, F.lit(horizon).alias("horizon_h"), "y_true",
                    (F.col("a") * F.col(y) + F.col("b") * F.col("_x") + F.col("c")).alias("y_pred"),
                    F.lit(horizon > lag).alias("uses_future_driver"))


def transfer_reanchored(df: DataFrame, coef: DataFrame, keys, x, y, horizon, lag=3, rebase=None, ts="ts") -> DataFrame:
    """Multi-step form re-anchored on each hour (``rebase=None``) or on the start of each ``rebase``-hour block.

    The driver inputs of the whole path come as one array and are folded; rows whose path has a
    gap are dropped.
    """
    reach = horizon + (rebase or 1)

    def make(f):
        e, v = F.col("_e"), F.struct(F.col("_e").alias("e"), F.col(x).alias("x"))
        path = F.collect_list(v).over(f.between(1 - lag - (rebase or 1), horizon - lag))
        cols = {"_path": path, "y_true": f.at(y, horizon)}
        if rebase:
            cols["_ys"] = F.collect_list(F.struct(e.alias("e"), F.col(y).alias("y"))).over(f.between(-(rebase - 1), 0))
        return cols

    h = windowed(df.withColumn("_t", F.unix_seconds(F.col(ts).cast("timestamp"))), keys, make, ts, back=lag + (rebase or 1), ahead=reach)
    j = h.join(coef, list(keys))
    t0 = F.floor(F.col("_t") / (rebase * 3600)) * (rebase * 3600) if rebase else F.col("_t")
    start = F.get(F.transform(F.filter("_ys", lambda s: s["e"] == t0), lambda s: s["y"]), F.lit(0)) if rebase else F.col(y)
    j = j.withColumn("_t0", t0).withColumn("_y0", start)
    steps = ((F.col("_t") - F.col("_t0")) / 3600 + horizon).cast("int")
    lo, hi = F.col("_t0") + (1 - lag) * 3600, F.col("_t") + (horizon - lag) * 3600
    xs = F.transform(F.filter("_path", lambda s: (s["e"] >= lo) & (s["e"] <= hi)), lambda s: s["x"])
    j = j.withColumn("_xs", xs).where((F.size("_xs") == steps) & F.col("_y0").isNotNull() & F.col("y_true").isNotNull())
    roll = F.aggregate("_xs", F.col("_y0"), lambda acc, v: acc * F.col("a") + v * F.col("b") + F.col("c"))
    return j.select(*keys, ts, F.lit(horizon).alias("horizon_h"), "y_true", roll.alias("y_pred"))


def affine_scan(a, b):
    """Composition of the maps ``x -> a[i] x + b[i]`` up to every i, as arrays (A, B), by doubling the composed length."""
    A, B = np.array(a, float), np.array(b, float)
    step = 1
    while step < len(A):
        B[step:] = A[step:] * B[:-step] + B[step:]
        A[step:] = A[step:] * A[:-step]
        step *= 2
    return A, B


def recursive_rollout(df: DataFrame, coef: DataFrame, keys, x, y, chunk_hours=24 * 366, ts="ts") -> DataFrame:
    """Recursion from one start value over a whole series, without holding a series in one task.

    A chunk maps its start state to its end state by ``s -> A s + B``. Chunk maps are composed by a scan
    over the few chunks of a series; every chunk then runs on its own from its start state, also by a scan.
    """
    src = df.join(coef.select(*keys, "a", "b", "c"), list(keys)).withColumn(
        "_chunk", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / (chunk_hours * 3600)).cast("long"))
    src = src.select(*keys, "_chunk", ts, F.col(x).alias("_x"), F.col(y).alias("_y"), "a", "b", "c")
    kt = _types(df, keys)

    def maps_of(pdf):
        a = float(pdf["a"].iloc[0])
        return affine_scan(np.full(len(pdf), a), pdf["b"].iloc[0] * pdf["_x"].to_numpy() + pdf["c"].iloc[0])

    def summarise(pdf):
        pdf = pdf.sort_values(ts)
        A, B = maps_of(pdf)
        row = {k: pdf[k].iloc[0] for k in [*keys, "_chunk"]}
        return pd.DataFrame([{**row, "A": A[-1], "B": B[-1], "y0": float(pdf["_y"].iloc[0])}])

    def compose(pdf):
        pdf = pdf.sort_values("_chunk").reset_index(drop=True)
        A, B = affine_scan(pdf["A"], pdf["B"])
        s = float(pdf["y0"].iloc[0])
        return pdf[[*keys, "_chunk"]].assign(start=np.concatenate(([s], A[:-1] * s + B[:-1])))

    def run(pdf):
        pdf = pdf.sort_values(ts)
        A, B = maps_of(pdf)
        return pdf[[*keys, ts, "_y"]].rename(columns={"_y": "y_true"}).assign(y_pred=A * float(pdf["start"].iloc[0]) + B)

    maps = src.groupBy(*keys, "_chunk").applyInPandas(summarise, f"{kt}, _chunk LONG, A DOUBLE, B DOUBLE, y0 DOUBLE")
    starts = maps.groupBy(*keys).applyInPandas(compose, f"{kt}, _chunk LONG, start DOUBLE")
    return src.join(starts, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(run, f"{kt}, {ts} TIMESTAMP_NTZ, y_true DOUBLE, y_pred DOUBLE")


# ---- transition operator -----------------------------------------------------------------

def fit_transition(feats: DataFrame, keys, horizons, beta=0.5) -> DataFrame:
    """Rollout readouts: ``w' K^h z`` folded into one weight vector per horizon, so scoring is ``score``."""
    def solve(pdf):
        K, w, n, mu, sigma = _operator(pdf, beta)
        key = {k: pdf[k].iloc[0] for k in keys}
        rows = []
        for h in horizons:
            v = np.linalg.matrix_power(K, h).T @ w[:-1]
            raw = v / sigma
            rows.append({**key, "horizon_h": h, "beta": float(beta), "n": n, "w": v, "b0": float(w[-1]), "w_raw": raw, "b_raw": float(w[-1] - raw @ mu)})
        return pd.DataFrame(rows)

    schema = f"{_types(feats, keys)}, horizon_h INT, beta DOUBLE, n LONG, w ARRAY<DOUBLE>, b0 DOUBLE, w_raw ARRAY<DOUBLE>, b_raw DOUBLE"
    return pair_moments(feats, keys).groupBy(*keys).applyInPandas(solve, schema)


def _operator(pdf, beta):
    """Transition matrix (no intercept), the same-hour readout, its labelled rows and the scale, from one key's moments."""
    part = {h: np.vstack(g.sort_values("i")["g"].to_list()) for h, g in pdf.groupby("h")}
    (G0, b0, _), = unpack(pdf[pdf["h"] < PAIRS], 1)
    mu, sigma, scale = standardised(part[-1])
    G0, b0 = scale((G0, b0))
    w = ridge(G0, b0, G0[-1, -1], beta)
    p = len(mu)
    n = int(round(G0[-1, -1]))
    if PAIRS not in part:  # no two consecutive hours: nothing is carried over
        return np.zeros((p, p)), w, n, mu, sigma
    T = np.diag(np.append(1.0 / sigma, 1.0))
    T[-1, :-1] = -mu / sigma
    G1, X = T.T @ part[PAIRS] @ T, T.T @ part[CROSS] @ T
    m = G1[-1, -1]
    K = np.linalg.solve(G1[:p, :p] / m + beta * np.eye(p), X[:p, :p] / m).T
    return K, w, n, mu, sigma


def mode_table(feats: DataFrame, keys, beta=0.5, top_k=8) -> DataFrame:
    """Slowest stable modes of the transition operator: decay time and period in hours."""
    def solve(pdf):
        # z(t + 1) = K z(t): a mode shrinks by |v| an hour and turns by arg v, so exp(-1/tau) = |v| and 2 pi / period = |arg v|.
        v = np.linalg.eigvals(_operator(pdf, beta)[0]).astype(complex)
        modes = pd.DataFrame({"re": v.real, "im": v.imag, "size": np.abs(v), "turn": np.abs(np.angle(v))}).query("0 < size < 1")
        modes = modes.assign(rank=-modes["size"].round(12), down=-modes["im"]).sort_values(["rank", "down"]).head(top_k)
        tau = -1 / np.log(modes["size"])
        period = 2 * np.pi / modes["turn"].where(modes["turn"] > 0)
        head = {k: [pdf[k].iloc[0]] * len(modes) for k in keys}
        return pd.DataFrame({**head, "mode": range(len(modes)), "eigenvalue": modes[["re", "im"]].to_dict("records"), "abs_lambda": modes["size"].to_numpy(),
                             "tau_hours": tau.to_numpy(), "period_hours": period.fillna(np.inf).to_numpy()})

    schema = f"{_types(feats, keys)}, mode INT, eigenvalue STRUCT<re: DOUBLE, im: DOUBLE>, abs_lambda DOUBLE, tau_hours DOUBLE, period_hours DOUBLE"
    return pair_moments(feats, keys).groupBy(*keys).applyInPandas(solve, schema)


# ---- tables about weights ----------------------------------------------------------------

def named_weights(models: DataFrame, names) -> DataFrame:
    """One row per (model, feature): index, name and standardised weight."""
    lookup = F.array(*[F.lit(n) for n in names])
    keep = [c for c in models.columns if c not in ("w", "w_raw", "b0", "b_raw", "mu", "sigma")]
    return models.select(*keep, F.posexplode("w").alias("idx", "w")).withColumn("name", F.get(lookup, F.col("idx")))


def family_importance(weights: DataFrame, name="name", w="w") -> DataFrame:
    """Totals of absolute weights per feature family and their share of the whole."""
    g = weights.groupBy(feature_family(name).alias("family")).agg(
        F.sum(F.abs(w)).alias("total"), F.avg(F.abs(w)).alias("mean"), F.count("*").alias("n"))
    g = stage(g)  # a handful of families; their sum is a scalar
    return g.select("family", "total", "mean", "n", F.round(F.col("total") / g.agg(F.sum("total")).scalar(), 4).alias("share"))
