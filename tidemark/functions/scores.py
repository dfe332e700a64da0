"""Loss and weight expressions on scalars and on quantile or ensemble arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .calendar import _c


def sigmoid_gate(x, crit, scale) -> Column:
    return F.lit(1.0) / (F.exp((F.lit(float(crit)) - _c(x)) / F.lit(float(scale))) + F.lit(1.0))


def lead_decay(horizon_h, h_eff) -> Column:
    return F.exp(-_c(horizon_h) / F.lit(float(h_eff)))


def pinball(q, y, tau) -> Column:
    u = _c(y) - q
    return F.greatest(tau * u, (tau - F.lit(1.0)) * u)


def pinball_vector(q_arr, y, taus) -> Column:
    """Element-wise pinball loss of a quantile vector against one truth."""
    return F.zip_with(_c(q_arr), F.array(*[F.lit(float(t)) for t in taus]), lambda q, t: pinball(q, y, t))


def tail_weights(state, horizon_h, taus, crit=67.0, gamma=1.0, scale=2.0, h_eff=48.0, mode="operator") -> Column:
    """Per-quantile weights that stress the upper tail near the critical level."""
    taus = F.array(*[F.lit(float(t)) for t in taus])
    if mode == "none":
        return F.transform(taus, lambda t: F.lit(1.0))
    gate = F.lit(0.5) if mode == "fixed" else sigmoid_gate(state, crit, scale)
    lift = F.lit(float(gamma)) * gate * lead_decay(horizon_h, h_eff)
    return F.transform(taus, lambda t: lift * F.greatest(t * 2.0 - 1.0, F.lit(0.0)) + 1.0)


def non_crossing(q_arr) -> Column:
    return F.array_sort(_c(q_arr))


def weighted_quantile_loss(q_arr, y, taus, weights) -> Column:
    """Mean over quantiles of weight times pinball loss, for one row."""
    terms = F.zip_with(pinball_vector(q_arr, y, taus), _c(weights), lambda l, w: l * w)
    return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / F.lit(float(len(taus)))


def threshold_crps(members, y, threshold) -> Column:
    """Exact threshold-weighted CRPS of an ensemble, integral of (F - 1{z>=y})^2 above the threshold.

    The empirical CDF is a step function, so the integral is a finite sum over the
    sorted members (and the truth) clipped at the threshold: no grid, no error.
    """
    r = F.lit(float(threshold))
    m = _c(members)
    y = F.greatest(_c(y), r)
    n = F.size(m).cast("double")
    low = F.size(F.filter(m, lambda v: v <= r)).cast("double")
    above = F.array_sort(F.filter(F.transform(m, lambda v: v.cast("double")), lambda v: v > r))
    # Walk the members above r; before each step the CDF is (low + i) / n.
    start = F.struct(F.lit(0.0).alias("area"), r.alias("z"), low.alias("k"))

    def piece(lo, hi, k):
        f = k / n
        left = F.greatest(F.least(hi, y) - lo, F.lit(0.0))
        right = F.greatest(hi - F.greatest(lo, y), F.lit(0.0))
        return f * f * left + (F.lit(1.0) - f) * (F.lit(1.0) - f) * right

    def step(acc, v):
        return F.struct((acc["area"] + piece(acc["z"], v, acc["k"])).alias("area"),
                        v.alias("z"), (acc["k"] + 1.0).alias("k"))

    # After the last member F = 1, so only the stretch up to the truth adds (width 1, F = 1 vs 0).
    return F.aggregate(above, start, step,
                       lambda acc: acc["area"] + F.greatest(y - acc["z"], F.lit(0.0)))


def risk_level(q_arr, crit=67.0, close=75.0) -> Column:
    """Level from the largest quantile: the cautious rule."""
    top = F.array_max(_c(q_arr))
    return F.when(top >= close, 2).when(top >= crit, 1).otherwise(0)
