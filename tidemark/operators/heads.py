"""Heads of unseen domains from sums over the heads of the source domains.

An extrapolating arm needs, per fold, only sums over its sources' heads: counts and coordinates, heads, their products, slopes
between neighbours on the coordinate, and sums weighted by functions of the coordinate. So no task sees all heads: domains stay
partitioned with their moments, folds go to them in slices of bounded size, and every task adds its domains' heads up per fold.
Leaving one more source out (the inner selection) subtracts that source's part where its moments are.

Weights such as a Gaussian around any point, of any width, or a flow along the coordinate, are smooth functions of the
coordinate. Their sums over heads come from ``Nodes``: the coordinate is cut into cells an eighth of its deviation to either
side; a cell with few domains keeps each as a node of its own (nothing is approximated), a fuller one interpolates at Chebyshev
points. The number of nodes follows from the spread of the coordinate, not from the number of domains.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage
from .linear import _types

#: Chebyshev points of a full cell, cells per deviation of the coordinate, and bytes of sums of a slice of folds.
POINTS, CELLS, SLICE_BYTES = 16, 4, 48 << 20


# ---- the coordinate -----------------------------------------------------------------------

@dataclass
class Nodes:
    """Points ``y`` on the coordinate and, per cell, which of them a domain's weight is spread over."""

    centre: float
    width: float
    cells: dict  # cell -> (first node, its points, exact)
    y: np.ndarray

    @staticmethod
    def of(centre, spread, cells):
        """``cells``: (cell, number of domains, their distinct coordinates if there are few)."""
        made, points = {}, []
        width = spread / CELLS if spread > 0 else 1.0
        for cell, _, own in sorted(cells, key=lambda c: c[0]):
            exact = own is not None
            at = np.sort(np.asarray(own, float)) if exact else centre + width * (cell + 0.5 + 0.5 * np.cos(np.pi * (np.arange(POINTS) + 0.5) / POINTS))
            made[cell] = (sum(map(len, points)), at, exact)
            points.append(at)
        return Nodes(centre, width, made, np.concatenate(points) if points else np.zeros(0))

    def spread(self, s):
        """(slice of the nodes, weights): f(s) is the weighted sum of f at these nodes."""
        first, at, exact = self.cells[int(np.floor((s - self.centre) / self.width))]
        if exact:
            return slice(first, first + len(at)), (at == s).astype(float)
        sign = (-1.0) ** np.arange(POINTS) * np.sin(np.pi * (np.arange(POINTS) + 0.5) / POINTS)
        gap = s - at
        if (gap == 0).any():
            return slice(first, first + POINTS), (gap == 0).astype(float)
        w = sign / gap
        return slice(first, first + POINTS), w / w.sum()


def nodes_of(peers: DataFrame, full) -> dict:
    """{key: Nodes} from rows (full, s); as many rows come back as there are cells."""
    where = peers.groupBy(*full).agg(F.avg("s").alias("_c"), F.stddev_pop("s").alias("_sd"))
    cell = F.floor((F.col("s") - F.col("_c")) / F.when(F.col("_sd") > 0, F.col("_sd") / CELLS).otherwise(1.0)).cast("long")
    rows = peers.join(where, full).withColumn("_cell", cell)
    counts = rows.groupBy(*full, "_c", "_sd", "_cell").agg(F.count("*").alias("_n"))
    few = rows.join(counts.where(F.col("_n") <= POINTS).select(*full, "_cell"), [*full, "_cell"]).groupBy(*full, "_cell").agg(F.collect_set("s").alias("_own"))
    found: dict = {}
    for r in counts.join(few, [*full, "_cell"], "left").collect():
        found.setdefault(tuple(r[k] for k in full), (r["_c"], r["_sd"], []))[2].append((r["_cell"], r["_n"], r["_own"]))
    return {k: Nodes.of(*v) for k, v in found.items()}


# ---- sums over heads ----------------------------------------------------------------------

class Layout:
    """Places of the sums of one arm in a row of numbers; ``P`` weights a head, ``B`` nodes."""

    def __init__(self, arm: str, P: int, B: int):
        self.pairs = arm == "koopman"
        square = (P, P)
        self.shapes = {"n": (), "u": (), "uu": (), "t": (P,), "v": (B, P), "c": (B,)} | (
            {"tt": square, "np": (), "d": (P,), "m": (P,), "dm": square, "mm": square} if self.pairs else {"t2": (P,), "ut": (P,)})
        at = 0
        self.at = {}
        for k, shape in self.shapes.items():
            size = int(np.prod(shape))
            self.at[k] = slice(at, at + size)
            at += size
        self.width = at

    def views(self, rows: np.ndarray) -> dict:
        return {k: rows[:, at].reshape(len(rows), *self.shapes[k]) for k, at in self.at.items()}

    def add(self, rows: np.ndarray, theta: np.ndarray, u: float, spread, sign: np.ndarray) -> None:
        """A domain's heads (one per fold) with sign 1, -1 or 0 per fold."""
        x = self.views(rows)
        own = theta * sign[:, None]
        x["n"] += sign
        x["u"] += u * sign
        x["uu"] += u * u * sign
        x["t"] += own
        at, w = spread
        x["v"][:, at] += w[:, None] * own[:, None, :]
        x["c"][:, at] += w * sign[:, None]
        if self.pairs:
            x["tt"] += own[:, :, None] * theta[:, None, :]
        else:
            x["t2"] += own * theta
            x["ut"] += u * own

    def add_pair(self, rows: np.ndarray, a, b, gap, sign) -> None:
        """Neighbours on the coordinate with heads ``a`` and ``b``, ``gap`` apart: slope and point half-way."""
        x = self.views(rows)
        on = sign != 0
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(on[:, None], (b - a) / gap[:, None], 0.0)
        m = np.where(on[:, None], (a + b) / 2, 0.0)
        own = sign[:, None]
        x["np"] += sign
        x["d"] += d * own
        x["m"] += m * own
        x["dm"] += d[:, :, None] * (m * own)[:, None, :]
        x["mm"] += m[:, :, None] * (m * own)[:, None, :]


def kernel(x, nodes: Nodes, at):
    """Logarithms of a Gaussian at the nodes around ``at`` with the sources' variance, per fold (none if all coincide)."""
    n = np.maximum(x["n"], 1)
    var = x["uu"] / n - (x["u"] / n) ** 2
    flat = var <= 1e-14 * np.maximum(x["uu"] / n, 1e-300)
    logit = -0.5 * (nodes.y[None, :] - np.reshape(at, (-1, 1))) ** 2 / np.where(flat, 1.0, var)[:, None]
    logit[flat] = 0.0
    used = np.abs(x["c"]) > 1e-9
    logit = logit - np.max(np.where(used, logit, -np.inf), axis=1, initial=-1e300, keepdims=True)
    return np.where(used, np.exp(np.minimum(logit, 50.0)), 0.0)


def subspace_from(x, nodes: Nodes, at, grid):
    """Heads (fold, choice, weight) at ``at``: per (dims, shrink) the ``dims`` weights that vary most move along the coordinate."""
    n = np.maximum(x["n"], 1)[:, None]
    mean, at = x["t"] / n, np.reshape(at, (-1, 1))
    u = x["u"][:, None] / n
    off = x["uu"][:, None] - n * u * u
    slope = (x["ut"] - u * x["t"]) / np.maximum(off, 1e-300)
    line = mean + slope * (at - nodes.centre - u)
    g = kernel(x, nodes, at)
    near = np.einsum("sb,sbp->sp", g, x["v"]) / np.sum(g * x["c"], axis=1, keepdims=True)
    rank = np.empty(mean.shape, int)
    order = np.argsort(-(x["t2"] / n - mean * mean), axis=1, kind="stable")
    np.put_along_axis(rank, order, np.arange(mean.shape[1])[None, :], axis=1)
    return np.stack([np.where(rank < d, k * line + (1 - k) * near, mean) for d, k in grid], axis=1)


def matrix_exps(A, times):
    """exp(A t) for every t, by scaling and squaring with a Taylor series."""
    norm = np.linalg.norm(A, 1) * np.max(np.abs(times), initial=0.0)
    j = max(0, int(np.ceil(np.log2(norm))) + 4) if norm > 0 and np.isfinite(norm) else 0
    B = A[None] * (np.asarray(times) / 2.0 ** j)[:, None, None]
    term = out = np.broadcast_to(np.eye(len(A)), B.shape)
    for i in range(1, 19):
        term = term @ B / i
        out = out + term
    for _ in range(j):
        out = out @ out
    return out


def generator_from(x, nodes: Nodes, at: float, n_latent: int, reg: float, damped):
    """The head at ``at`` and a record, of one fold: heads drift by x' = A x + drift in the plane of their largest variation."""
    K = int(round(float(x["n"])))
    mean = x["t"] / K
    power, basis = np.linalg.eigh(x["tt"] - K * np.outer(mean, mean))
    n = min(max(1, min(n_latent, K - 2)), K)
    power, basis = np.maximum(power[::-1], 0), basis[:, ::-1][:, :n]
    A, drift = np.zeros((n, n)), np.zeros(n)
    if K >= 3:
        pairs, m, d = float(x["np"]), x["m"], x["d"]
        mm = basis.T @ (x["mm"] - np.outer(mean, m) - np.outer(m, mean) + pairs * np.outer(mean, mean)) @ basis
        half = basis.T @ (m - pairs * mean)
        left = np.block([[mm, half[:, None]], [half[None, :], np.array([[pairs]])]])
        rate = np.hstack([basis.T @ (x["dm"] - np.outer(d, mean)) @ basis, (basis.T @ d)[:, None]])
        found = np.linalg.solve(left + reg * np.eye(n + 1), rate.T).T
        A, drift = damped(found[:, :n]), found[:, n]
    whole = np.zeros((n + 1, n + 1))
    whole[:n, :n], whole[:n, n] = A, drift
    g = kernel({k: np.asarray(v)[None] for k, v in x.items()}, nodes, at)[0]
    on = np.flatnonzero(g)
    state = np.hstack([(x["v"][on] - x["c"][on, None] * mean) @ basis, x["c"][on, None]])
    moved = np.einsum("b,bij,bj->i", g[on], matrix_exps(whole, at - nodes.y[on]), state)[:n] / np.sum(g * x["c"])
    ev = np.append(np.linalg.eigvals(A), 0)
    return mean + basis @ moved, {"n_latent": n, "eig_absmax": float(np.abs(ev).max()), "eig_re_max": float(ev.real.max()), "sv_ratio": float(power[0] / max(power.sum(), 1e-300))}


# ---- domains and folds --------------------------------------------------------------------

def split_moments(a):
    """``[G, b, yy]`` of an array of a domain's moments, or None."""
    if a is None or np.ndim(a) == 0:
        return None
    a = np.asarray(a, float)
    q = int(round((np.sqrt(4 * len(a) - 3) - 1) / 2))
    return a[: q * q].reshape(q, q), a[q * q : -1], float(a[-1])


def heads_of(m, mu, sd, beta):
    """Heads of one domain on every fold's scale (rows): ridge with the penalty on that scale."""
    G, b, _ = m
    n = G[-1, -1]
    pen = np.concatenate([sd * sd, np.zeros((len(sd), 1))], axis=1) * np.reshape(beta, (-1, 1))
    A = np.broadcast_to(G / n, (len(sd), *G.shape)).copy()
    A[:, np.arange(len(b)), np.arange(len(b))] += pen
    w = np.linalg.solve(A, np.broadcast_to(b / n, (len(sd), len(b)))[:, :, None])[:, :, 0]
    return np.concatenate([w[:, :-1] * sd, w[:, -1:] + np.sum(mu * w[:, :-1], axis=1, keepdims=True)], axis=1)


def mse_of(m, theta, mu, sd):
    """Mean squared error of heads (fold, choice, weight), given on their fold's scale."""
    G, b, yy = m
    w = theta[:, :, :-1] / sd[:, None, :]
    w = np.concatenate([w, theta[:, :, -1:] - np.sum(w * mu[:, None, :], axis=2, keepdims=True)], axis=2)
    return (np.einsum("scp,pq,scq->sc", w, G, w) - 2 * w @ b + yy) / G[-1, -1]


class Folds:
    """A slice of the folds of one key, as arrays."""

    def __init__(self, rows, forward):
        self.domain = np.array([r["domain"] for r in rows], object)
        self.s = np.array([r["s"] for r in rows], float)
        self.forward = forward

    def sources(self, domain, s):
        """Which folds a domain is a source of."""
        other = self.domain != domain
        return other & (s < self.s) if self.forward else other


def over_domains(rows: DataFrame, full, folds: dict, widths: int, each) -> dict:
    """{(key, fold number): sums}: ``each(row, folds, sums)`` adds a domain's part to the sums (fold, ``widths``) of its key's folds.

    Domains are read where they are; a task sends one row per fold of the slice, and Spark adds these up.
    """
    from .domains import _array_sum

    columns = [*full, "i", "v"]
    table = rows.sparkSession.sparkContext.broadcast(folds)

    def run(frames):
        sums = {}
        for f in frames:
            for r in f.to_dict("records"):
                key = tuple(r[k] for k in full)
                mine = table.value.get(key)
                if mine is not None:
                    if key not in sums:
                        sums[key] = np.zeros((len(mine.s), widths))
                    each(r, key, mine, sums[key])
        for key, x in sums.items():
            x = np.where(np.isnan(x), np.inf, x)  # a frame's NaN would arrive as null; what is not finite stays not finite
            yield pd.DataFrame({**{k: [v] * len(x) for k, v in zip(full, key)}, "i": range(len(x)), "v": list(x)})[columns]

    parts = rows.mapInPandas(run, f"{_types(rows, full)}, i INT, v ARRAY<DOUBLE>")
    found = parts.groupBy(*full, "i").agg(_array_sum("v").alias("v")).collect()
    return {(tuple(r[k] for k in full), r["i"]): np.array(r["v"]) for r in found}


NEIGHBOURS = ("prev1", "prev2", "next1", "next2")


def with_neighbours(rows: DataFrame, full) -> DataFrame:
    """Rows with the two sources before and after them on the coordinate: names, places and moments.

    Only names and places are ordered; moments follow by a join on the domain.
    """
    order = Window.partitionBy(*full).orderBy("s", "domain")
    peers = rows.where("train IS NOT NULL").select(*full, "domain", "s")
    me = F.struct("s", "domain")
    near = peers.select(*full, "domain", F.lag(me, 1).over(order).alias("prev1"), F.lag(me, 2).over(order).alias("prev2"),
                        F.lead(me, 1).over(order).alias("next1"), F.lead(me, 2).over(order).alias("next2"))
    out = rows.join(near, [*full, "domain"], "left")
    for c in NEIGHBOURS:
        other = rows.select(*full, F.col("domain").alias(f"{c}_domain"), F.col("s").alias(f"{c}_s"), F.col("train").alias(f"{c}_train"), F.col("merged").alias(f"{c}_merged"))
        out = out.withColumn(f"{c}_domain", F.col(f"{c}.domain")).drop(c).join(other, [*full, f"{c}_domain"], "left")
    return out


def around(r, folds: Folds, side: str):
    """(which neighbour stands next to the domain, per fold: 0 none, 1 or 2): the held-out domain is skipped."""
    first, second = r[f"{side}1_domain"], r[f"{side}2_domain"]
    ok1 = folds.sources(first, r[f"{side}1_s"]) if first is not None else np.zeros(len(folds.s), bool)
    ok2 = folds.sources(second, r[f"{side}2_s"]) if second is not None else np.zeros(len(folds.s), bool)
    return np.where(ok1, 1, np.where(ok2, 2, 0))


def chosen(r, side, which, part, mu, sd, beta, P):
    """Heads and places of the neighbours picked by ``which``."""
    theta, s = np.zeros((len(which), P)), np.zeros(len(which))
    for k in (1, 2):
        at = which == k
        if at.any():
            theta[at] = heads_of(split_moments(r[f"{side}{k}_{part}"]), mu[at], sd[at], np.reshape(beta, (-1, 1))[at] if np.ndim(beta) else beta)
            s[at] = r[f"{side}{k}_s"]
    return theta, s


def add_domain(layout, sums, r, folds, nodes, part, beta, mu, sd, on):
    """Adds a source's heads of all folds, and its pair with the next source."""
    theta = heads_of(split_moments(r[part]), mu, sd, beta)
    layout.add(sums, theta, r["s"] - nodes.centre, nodes.spread(r["s"]), on.astype(float))
    if layout.pairs:
        which = around(r, folds, "next") * on
        b, s = chosen(r, "next", which, part, mu, sd, beta, theta.shape[1])
        layout.add_pair(sums, theta, b, s - r["s"], (which > 0).astype(float))


def drop_domain(layout, sums, r, folds, nodes, beta, mu, sd, on):
    """Takes a source's training heads out of the sums again; its neighbours become a pair."""
    theta = heads_of(split_moments(r["train"]), mu, sd, beta)
    layout.add(sums, theta, r["s"] - nodes.centre, nodes.spread(r["s"]), -on.astype(float))
    if layout.pairs:
        P = theta.shape[1]
        before, after = around(r, folds, "prev") * on, around(r, folds, "next") * on
        a, s_a = chosen(r, "prev", before, "train", mu, sd, beta, P)
        b, s_b = chosen(r, "next", after, "train", mu, sd, beta, P)
        layout.add_pair(sums, a, theta, r["s"] - s_a, -(before > 0).astype(float))
        layout.add_pair(sums, theta, b, s_b - r["s"], -(after > 0).astype(float))
        layout.add_pair(sums, a, b, s_b - s_a, ((before > 0) & (after > 0)).astype(float))


def fit_heads(moments: DataFrame, coords: DataFrame, task, spec, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Models of the arms ``subspace`` and ``koopman`` for every (task, coordinate, held-out domain).

    Per slice of folds: the folds' scales, the sums over the sources' training heads, the inner risks (each source left
    out once more, where it is), the choices, and the sums over the refitted heads, from which the models follow.
    """
    from .domains import FIELDS, RECORD, damped, domain_parts

    full, forward = [*task, "coord"], spec.protocol == "forward"
    rows = domain_parts(moments, task).join(coords, "domain")
    rows = rows.withColumn("merged", F.when(F.col("val").isNull(), F.col("train")).otherwise(F.zip_with("train", "val", lambda a, b: a + b)))
    arms = [a for a in spec.arms if a in ("subspace", "koopman")]
    if "koopman" in arms:
        rows = with_neighbours(stage(rows), full)
    rows = stage(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism))  # read once per pass: real work per row, few rows
    sources = rows.where("train IS NOT NULL")
    nodes = nodes_of(sources.select(*full, "s"), full)
    first = sources.select(F.size("scale").alias("size")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], f"{_types(rows, full)}, {_types(rows, ['domain'])}, s DOUBLE, arm STRING, {RECORD}")
    p = first["size"] // 2
    P, B = p + 1, max((len(x.y) for x in nodes.values()), default=0)
    variants = [(a, b) for a in arms for b in ((spec.theta_beta,) if a == "subspace" else spec.betas)]
    # Node tables of the keys differ in length; the sums of a key use the first of the places.
    layouts = {(key, a): Layout(a, P, len(x.y)) for key, x in nodes.items() for a in arms}
    most = {a: Layout(a, P, B).width for a in arms}
    grid = [(d, k) for d in spec.dims for k in spec.shrinks]
    choices = {a: grid if a == "subspace" else [None] for a in arms}
    width = sum(most[a] for a, _ in variants)
    starts = dict(zip(variants, np.cumsum([0, *[most[a] for a, _ in variants]]).tolist()))
    risk_at = dict(zip(variants, np.cumsum([0, *[1 + len(choices[a]) for a, _ in variants]]).tolist()))
    n_risks = sum(1 + len(choices[a]) for a, _ in variants)
    schema = f"{_types(rows, full)}, {_types(rows, ['domain'])}, s DOUBLE, arm STRING, {RECORD}"
    made = None
    wanted = rows.select(*full, "domain", "s").toLocalIterator()
    while part := list(itertools.islice(wanted, max(1, slice_bytes // (8 * width)))):
        folds = {}
        for r in part:
            folds.setdefault(tuple(r[k] for k in full), []).append(r)
        folds = {k: Folds(v, forward) for k, v in folds.items() if k in nodes}

        def scales(r, key, mine, sums):
            G, _, _ = split_moments(r["train"])
            on = mine.sources(r["domain"], r["s"])
            own = np.concatenate([[1.0], G[-1], np.diag(G)[:-1], r["scale"]])
            sums[on] += own

        got = over_domains(sources, full, folds, 1 + P + p + 2 * p, scales)
        for key, mine in folds.items():
            x = np.array([got.get((key, i), np.zeros(1 + P + 3 * p)) for i in range(len(mine.s))])
            mine.n = x[:, 0].round().astype(int)
            k = np.maximum(x[:, :1], 1)
            if spec.scale == "pooled":
                rows_n = np.maximum(x[:, P : P + 1], 1e-300)
                mine.mu = x[:, 1:P] / rows_n
                mine.sd = np.sqrt(np.maximum(x[:, 1 + P : 1 + P + p] / rows_n - mine.mu ** 2, 0.0))
            else:
                mine.mu, mine.sd = x[:, 1 + P + p : 1 + P + 2 * p] / k, x[:, 1 + P + 2 * p :] / k
            mine.sd = np.where(mine.sd < 1e-12, 1.0, mine.sd)

        def train_heads(r, key, mine, sums):
            on = mine.sources(r["domain"], r["s"])
            for a, b in variants:
                lay = layouts[key, a]
                add_domain(lay, sums[:, starts[a, b] : starts[a, b] + lay.width], r, mine, nodes[key], "train", b, mine.mu, mine.sd, on)

        sums = over_domains(sources, full, folds, width, train_heads)
        for key, mine in folds.items():
            mine.sums = np.array([sums.get((key, i), np.zeros(width)) for i in range(len(mine.s))])

        def risks(r, key, mine, out):
            v = split_moments(r["val"])
            on = mine.sources(r["domain"], r["s"])
            if v is None or not on.any():
                return
            for a, b in variants:
                lay, at = layouts[key, a], risk_at[a, b]
                ok = on & (mine.n >= (3 if a == "subspace" else 4))
                if not ok.any():
                    continue
                left = mine.sums[:, starts[a, b] : starts[a, b] + lay.width].copy()
                with np.errstate(all="ignore"):
                    drop_domain(lay, left, r, mine, nodes[key], b, mine.mu, mine.sd, ok)
                    x = {k: y[ok] for k, y in lay.views(left).items()}
                    if a == "subspace":
                        theta = subspace_from(x, nodes[key], r["s"], grid)
                    else:
                        theta = np.full((int(ok.sum()), 1, P), np.nan)
                        for i in range(len(theta)):
                            try:
                                theta[i, 0] = generator_from({k: y[i] for k, y in x.items()}, nodes[key], r["s"], spec.n_latent, spec.generator_ridge, damped)[0]
                            except np.linalg.LinAlgError:
                                pass  # stays NaN: the choice has no finite risk
                    out[ok, at] += 1
                    out[ok, at + 1 : at + 1 + len(choices[a])] += mse_of(v, theta, mine.mu[ok], mine.sd[ok])

        found = over_domains(sources, full, folds, n_risks, risks)
        for key, mine in folds.items():
            mine.sums = None
            mine.pick = []
            for i in range(len(mine.s)):
                x, pick = found.get((key, i), np.zeros(n_risks)), {}
                for a in arms:
                    tried = []
                    for b in [b for c, b in variants if c == a]:
                        at = risk_at[a, b]
                        with np.errstate(all="ignore"):
                            tried += [(x[at + 1 + k] / x[at] if x[at] else np.nan, len(tried) + k, b, c) for k, c in enumerate(choices[a])]
                    known = [t for t in tried if np.isfinite(t[0])]
                    default = (np.nan, 0, spec.theta_beta, (4, 0.6)) if a == "subspace" else (np.nan, 0, spec.betas[0], None)
                    risk, _, beta, choice = min(known, key=lambda t: t[:2]) if known else default
                    pick[a] = (beta, choice, risk)
                mine.pick.append(pick)

        offset = dict(zip(arms, np.cumsum([0, *[most[a] for a in arms]]).tolist()))

        def merged_heads(r, key, mine, sums):
            on = mine.sources(r["domain"], r["s"])
            for a in arms:
                lay = layouts[key, a]
                beta = np.array([x[a][0] for x in mine.pick])
                add_domain(lay, sums[:, offset[a] : offset[a] + lay.width], r, mine, nodes[key], "merged", beta, mine.mu, mine.sd, on)

        last = over_domains(sources, full, folds, sum(most.values()), merged_heads)
        models = []
        for key, mine in folds.items():
            for i, (domain, s) in enumerate(zip(mine.domain, mine.s)):
                for a in arms:
                    row = {**dict(zip(full, key)), "domain": domain, "s": float(s), "arm": a, "n_sources": int(mine.n[i])}
                    models.append(row | head_at(layouts[key, a], last.get((key, i)), offset[a], nodes[key], float(s), mine.mu[i], mine.sd[i], mine.pick[i][a], int(mine.n[i]), spec, damped))
        names = [*full, "domain", "s", "arm", *FIELDS]
        out = stage(rows.sparkSession.createDataFrame([tuple(m.get(c) for c in names) for m in models], schema))
        made = out if made is None else made.unionByName(out)
    return made


def head_at(layout, sums, offset, nodes, s_star, mu, sd, pick, n, spec, damped) -> dict:
    """One fold's model from its sums, or its error."""
    beta, choice, risk = pick
    try:
        if n < spec.min_sources:
            raise ValueError(f"needs {spec.min_sources} sources, has {n}")
        x = layout.views(sums[None, offset : offset + layout.width])
        with np.errstate(all="ignore"):
            if layout.pairs:
                w, info = generator_from({k: y[0] for k, y in x.items()}, nodes, s_star, spec.n_latent, spec.generator_ridge, damped)
            else:
                w = subspace_from(x, nodes, s_star, [choice])[0, 0]
                info = {"dims": int(min(choice[0], len(w))), "shrink": float(choice[1])}
        if not np.isfinite(w).all():
            raise ValueError("the extrapolated head is not finite")
    except (ValueError, np.linalg.LinAlgError) as ex:
        return {"error": f"{type(ex).__name__}: {ex}"}
    raw = w[:-1] / sd
    return {"beta": float(beta), "inner_risk": float(risk) if np.isfinite(risk) else None, **info, "w_raw": [float(v) for v in raw], "b_raw": float(w[-1] - raw @ mu)}
