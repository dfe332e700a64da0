"""Strictly causal features: lags, moving averages, humidity ratios, labels and windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import HOUR, calendar_encoding, epoch_s
from ..functions.physics import (KELVIN, MAGNUS_ALDUCHOV, MAGNUS_SONNTAG, R_VAPOUR, clip, saturation_density,
                                 saturation_pa, vapour_density)
from .chunks import windowed, with_halo
from .moments import MAX_BYTES, MODEL_BYTES, add_moments, emit_moments, held_bytes, key_slices, matrix, moment_schema, summed_moments


@dataclass(frozen=True)
class FeatureSpec:
    """What a feature vector holds; the order of parts fixes the order of ``psi``."""

    drivers: tuple[str, ...] = ("t_c", "rh", "rain", "wind", "p_hpa")
    lags: int = 48
    windows: tuple[int, ...] = (24, 72, 168, 720, 2160, 8760)
    slow: bool = True
    ratio: bool = True
    strict: bool = False
    mean_of: tuple[str, ...] = ("t_c",)
    step: int = HOUR

    def names(self) -> list[str]:
        out = [f"{d}_lag{k}" for k in range(self.lags) for d in self.drivers]
        if self.slow:
            out += [f"{c}_ma{w}" for w in self.windows for c in self.mean_of]
        if self.slow and self.ratio:
            out += [f"q_ma{w}" for w in self.windows]
        if self.ratio:
            out += [f"ratio_ma{w}" for w in self.windows]
        return out


def moving_means(f, col, w, strict=False) -> Column:
    """Mean of the last ``w`` steps; expanding at the start unless ``strict``."""
    n = f.count(col, w)
    mean = f.total(col, w) / F.nullif(n, F.lit(0))
    return F.when(n == w, mean) if strict else mean


def causal_means(df, keys, cols, windows, strict=False, ts="ts", step=HOUR, chunk=None) -> DataFrame:
    def make(f):
        return {f"{c}_ma{w}": moving_means(f, c, w, strict) for c in cols for w in windows}

    return windowed(df, keys, make, ts, back=max(windows), step=step, chunk=chunk)


def slow_ratio(q_mean, t_mean) -> Column:
    """Equivalent humidity of the slow state, in percent, limited to 0..120."""
    return clip(q_mean / saturation_density(t_mean) * 100.0, 0, 120)


class Block:
    """One (series, chunk) with its halo as dense arrays on the time step; gaps are NaN."""

    def __init__(self, table, step):
        e = table.column("_e").to_numpy()
        self.order = np.argsort(e, kind="stable")
        self.table = table.take(pa.array(self.order))
        e = e[self.order]
        if ((e - e[0]) % step).any():
            raise ValueError("rows are not on the time step; floor the timestamps first")
        self.pos = (e - e[0]) // step
        self.size = int(self.pos[-1]) + 1
        self.home = self.table.column("_chunk").to_numpy() == self.table.column("_home").to_numpy()

    def dense(self, name):
        out = np.full(self.size, np.nan)
        out[self.pos] = self.table.column(name).to_numpy().astype(float)
        return out

    def lags(self, names, n):
        """(rows, n * drivers): lag-major, lag 0 first; NaN before the start and in gaps."""
        pad = np.full((n - 1, len(names)), np.nan)
        seq = np.vstack([pad, np.column_stack([self.dense(c) for c in names])])
        win = np.lib.stride_tricks.sliding_window_view(seq, n, axis=0)[self.pos]
        return win[:, :, ::-1].transpose(0, 2, 1).reshape(len(self.pos), -1)

    def mean(self, name, w, strict=False):
        x = self.dense(name)
        ok = np.isfinite(x)
        shift = x[ok].mean() if ok.any() else 0.0  # keeps the running sums small
        total = np.concatenate([[0.0], np.cumsum(np.where(ok, x - shift, 0.0))])
        count = np.concatenate([[0], np.cumsum(ok)])
        hi = self.pos + 1
        lo = np.maximum(hi - w, 0)
        n = count[hi] - count[lo]
        with np.errstate(invalid="ignore", divide="ignore"):
            m = (total[hi] - total[lo]) / n + shift
        return np.where(n == w, m, np.nan) if strict else m

    def ahead(self, name, steps):
        x = np.concatenate([self.dense(name), np.full(max(steps) + 1, np.nan)])
        return x[self.pos[:, None] + np.asarray(steps)[None, :]]

    def output(self, columns, vectors, keep):
        """Kept rows with their vectors; a vector given as a function is built for the kept rows only."""
        rows, at = self.table.select(columns).filter(pa.array(keep)), np.flatnonzero(keep)
        for name, values in vectors.items():
            flat = np.ascontiguousarray(values(at) if callable(values) else values[keep])
            n, p = flat.shape
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * p)
            rows = rows.append_column(name, pa.ListArray.from_arrays(ends, pa.array(flat.ravel(), from_pandas=True)))
        return rows


def in_blocks(df, keys, columns, names, make, ts, back, ahead, step, chunk):
    """Append vectors: ``make(block)`` gives ({name: matrix}, rows to keep) per (series, chunk)."""
    halo = with_halo(df, ts, back, ahead, step, chunk)
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(table):
        blk = Block(table, step)
        vectors, keep = make(blk)
        return blk.output(columns, vectors, keep & blk.home)

    schema = ", ".join([f"`{c}` {types[c]}" for c in columns] + [f"{n} ARRAY<DOUBLE>" for n in names])
    # The output is many times wider than the input: an explicit partition count keeps AQE from
    # merging small-looking input partitions into one task.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return halo.repartition(n, *keys, "_chunk").groupBy(*keys, "_chunk").applyInArrow(run, schema)


def fold_blocks(df, keys, make, start, add, emit, schema, ts, back, ahead, step, chunk) -> DataFrame:
    """Consume vectors where they are built: ``add(state, block, vectors, keep)`` per (series, chunk), ``emit(state)`` batches.

    Wide vectors never leave the task. A task holds one block and its state; ``add`` may return batches when the state
    grows too large. Rows of the halo are in the block: ``block.home`` tells the others.
    """
    halo = with_halo(df, ts, back, ahead, step, chunk)
    group = [*keys, "_chunk"]

    def run(batches):
        state, held, last = start(), [], None

        def flush():
            blk = Block(pa.Table.from_batches(held), step)
            vectors, keep = make(blk)
            return add(state, blk, vectors, keep) or ()

        for b in batches:
            if not b.num_rows:
                continue
            frame = b.select(group).to_pandas()
            new = np.flatnonzero((frame != frame.shift()).any(axis=1).to_numpy())
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), b.num_rows]):
                key = tuple(frame.iloc[lo])
                if held and key != last:
                    yield from flush()
                    held.clear()
                last = key
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from flush()
        yield from emit(state)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return halo.repartition(n, *group).sortWithinPartitions(*group).mapInArrow(run, schema)


def _recipe(df, keys, spec, ts, carry, labels, keep_warm):
    """(source rows, function of a block, steps needed before and after) of a feature vector."""
    needs_q = spec.ratio
    need = {*spec.drivers, *(spec.mean_of if spec.slow else ()), *(("t_c", "rh") if needs_q else ()),
            *((labels[0],) if labels else ())}
    src = df.select(*keys, ts, *[c for c in dict.fromkeys([*carry, *sorted(need)]) if c not in (*keys, ts)])
    if needs_q:
        src = src.withColumn("_q", vapour_density("rh", "t_c"))

    def make(b):
        parts = [b.lags(spec.drivers, spec.lags)]
        if spec.slow:
            parts += [b.mean(c, w, spec.strict)[:, None] for w in spec.windows for c in spec.mean_of]
        if needs_q:
            q = {w: b.mean("_q", w, spec.strict) for w in spec.windows}
            if spec.slow:
                parts += [q[w][:, None] for w in spec.windows]
            parts += [ratio_of_means(q[w], b.mean("t_c", w, spec.strict))[:, None] for w in spec.windows]
        psi = np.hstack(parts)
        out = {"psi": psi} | ({"labels": b.ahead(*labels)} if labels else {})
        return out, np.ones(len(psi), bool) if keep_warm else np.isfinite(psi).all(axis=1)

    return src, make, max([spec.lags, *(spec.windows if spec.slow or spec.ratio else ())]), max(labels[1]) if labels else 0


def build_features(df, keys, spec: FeatureSpec = FeatureSpec(), ts="ts", carry=(), chunk=None, keep_warm=False, labels=None) -> DataFrame:
    """Rows ``(keys, ts, carry…, psi)``; rows without a full window are dropped unless ``keep_warm``.

    ``labels=(target, horizons)`` adds the target's leads as an array from the same block, which
    saves the join of two wide tables.

    Spark cuts and shuffles the series into bounded (series, chunk) blocks with a halo; inside a
    block the vectors are built as Arrow arrays. ``df`` is unique on (keys, ts).
    """
    src, make, back, ahead = _recipe(df, keys, spec, ts, carry, labels, keep_warm)
    return in_blocks(src, keys, [*keys, ts, *carry], ["psi", "labels"] if labels else ["psi"], make, ts, back, ahead, spec.step, chunk)


def feature_moments(df, keys, group, spec: FeatureSpec, labels, ts="ts", chunk=None) -> DataFrame:
    """``grams`` of the feature vectors per ``group`` (columns of ``df``), without the vectors ever leaving the task that builds them."""
    src, make, back, ahead = _recipe(df, keys, spec, ts, [c for c in group if c not in keys], labels, False)

    def add(acc, blk, vectors, keep):
        A = np.column_stack([vectors["psi"], np.ones(len(vectors["psi"]))])
        for key, idx in key_slices(blk.table, list(group)):
            idx = idx[(keep & blk.home)[idx]]
            if len(idx):
                add_moments(acc, key, A[idx], vectors["labels"][idx])
        if held_bytes(acc) > MAX_BYTES:
            yield from emit_moments(group, acc)
            acc.clear()

    parts = fold_blocks(src, keys, make, dict, add, lambda acc: emit_moments(group, acc), moment_schema(src, group), ts, back, ahead, spec.step, chunk)
    return summed_moments(parts, group)


def feature_sums(df, keys, spec: FeatureSpec, ts="ts", chunk=None) -> DataFrame:
    """(keys, n_rows, total): rows with a full window and the sum of their vectors, per series."""
    src, make, back, ahead = _recipe(df, keys, spec, ts, (), None, False)

    def add(acc, blk, vectors, keep):
        for key, idx in key_slices(blk.table, list(keys)):
            idx = idx[(keep & blk.home)[idx]]
            if len(idx):
                n, total = acc.get(key, (0, 0.0))
                acc[key] = n + len(idx), total + vectors["psi"][idx].sum(axis=0)

    def emit(acc):
        for key, (n, total) in acc.items():
            yield pa.RecordBatch.from_pydict({**{k: pa.array([v]) for k, v in zip(keys, key)}, "n_rows": pa.array([n], pa.int64()),
                                              "total": pa.array([total], pa.list_(pa.float64()))})

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["n_rows LONG", "total ARRAY<DOUBLE>"])
    parts = fold_blocks(src, keys, make, dict, add, emit, schema, ts, back, ahead, spec.step, chunk)
    return parts.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))


#: Codes of the moment rows of consecutive hours, beside those of ``grams``.
PAIRS, CROSS = 100, 101


def pair_moments(feats, keys, ts="ts", psi="psi", labels="labels", step=HOUR, chunk=None) -> DataFrame:
    """Moment rows of the vectors with their first label, and of pairs (vector, vector a step later).

    ``PAIRS`` is the matrix of [psi, 1] over rows that have a next one, ``CROSS`` the products of these with the next ones.
    Rows meet their next one inside their (series, chunk) block; nothing is joined, and no label per vector entry is needed.
    """
    src = feats.select(*keys, ts, psi, F.slice(labels, 1, 1).alias(labels))

    def add(acc, blk, vectors, keep):
        A = np.column_stack([matrix(blk.table.column(psi)), np.ones(len(blk.pos))])
        key = tuple(blk.table.column(k)[0].as_py() for k in keys)
        home = np.flatnonzero(blk.home)
        if len(home):
            add_moments(acc, key, A[home], matrix(blk.table.column(labels))[home])
        at = np.flatnonzero((np.diff(blk.pos) == 1) & blk.home[:-1])
        if len(at):
            for code, m in ((PAIRS, A[at].T @ A[at]), (CROSS, A[at].T @ A[at + 1])):
                acc[key, code] = acc[key, code] + m if (key, code) in acc else m
        if held_bytes(acc) > MAX_BYTES:
            yield from emit_moments(keys, acc)
            acc.clear()

    make = lambda b: ({}, np.ones(len(b.pos), bool))
    parts = fold_blocks(src, keys, make, dict, add, lambda acc: emit_moments(keys, acc), moment_schema(src, keys), ts, 0, 1, step, chunk)
    return summed_moments(parts, keys)


def score_features(df, keys, models, model_key, spec: FeatureSpec, labels, readouts, carry=(), ts="ts", chunk=None) -> DataFrame:
    """Rows ``(keys, ts, carry…, labels, preds)``: all readouts of a row from one matrix product per block.

    ``models`` has ``model_key``, ``readouts`` (names of the columns that tell a key's readouts apart, in the order of ``preds``),
    ``w_raw`` and ``b_raw``; its size is checked before it is sent. ``labels=(target, horizons)`` adds the truth path.
    """
    names = [*model_key, *readouts, "w_raw", "b_raw"]
    size = models.agg(F.sum(F.size("w_raw")) * 8).first()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"{size} bytes of models; score them in parts of {MODEL_BYTES} bytes")
    table = {}
    for r in models.select(*names).orderBy(*model_key, *readouts).collect():
        W, b = table.setdefault(tuple(r[k] for k in model_key), ([], []))
        W.append(r["w_raw"])
        b.append(r["b_raw"])
    sent = df.sparkSession.sparkContext.broadcast({k: (np.array(W).T, np.array(b)) for k, (W, b) in table.items()})
    width = max((len(b) for _, b in table.values()), default=0)
    carry = list(dict.fromkeys([*[c for c in model_key if c not in keys], *[c for c in carry if c not in keys]]))
    src, make, back, ahead = _recipe(df, keys, spec, ts, carry, labels, False)

    def scored(b):
        vectors, keep = make(b)
        preds = np.full((len(b.pos), width), np.nan)
        for key, idx in key_slices(b.table, list(model_key)):
            if key in sent.value:
                W, b0 = sent.value[key]
                idx = idx[keep[idx]]
                preds[idx, : len(b0)] = vectors["psi"][idx] @ W + b0
        return {"preds": preds} | ({"labels": vectors["labels"]} if labels else {}), keep

    return in_blocks(src, keys, [*keys, ts, *carry], ["preds", "labels"] if labels else ["preds"], scored, ts, back, ahead, spec.step, chunk)


def ratio_of_means(q, t):
    """``slow_ratio`` on arrays."""
    scale, slope, offset = MAGNUS_ALDUCHOV
    rho = scale * np.exp(slope * t / (offset + t)) / (R_VAPOUR * (t + KELVIN))
    return np.clip(q / rho * 100.0, 0.0, 120.0)


SITE_SPEC = FeatureSpec(drivers=("t_c", "rh"), lags=24, windows=(6, 24, 72), ratio=False, strict=True, mean_of=("t_c", "rh"))
YEAR_SPEC = FeatureSpec(lags=24, windows=(24, 72, 168), ratio=False, strict=True,
                        mean_of=("t_c", "rh", "rain", "wind", "p_hpa"))


def with_saturation_terms(feats: DataFrame, obs: DataFrame, keys, ts="ts") -> DataFrame:
    """Append saturation pressure (hPa) and its product with humidity to ``psi`` (56 columns for SITE_SPEC)."""
    es = saturation_pa("t_c", MAGNUS_SONNTAG) / 100.0
    extra = obs.select(*keys, ts, F.array(es, F.col("rh") * es).alias("_x"))
    return (feats.join(extra, [*keys, ts]).withColumn("psi", F.concat("psi", "_x")).drop("_x")
            .where(~F.exists("psi", lambda v: v.isNull())))


def with_calendar_terms(feats: DataFrame, valid_ts) -> DataFrame:
    enc = calendar_encoding(valid_ts)
    return feats.withColumn("psi", F.concat("psi", F.array(*[enc[k] for k in ("hour_sin", "hour_cos", "year_sin", "year_cos")])))


def feature_subset(psi, names, keep) -> Column:
    """Pick the vector entries whose name satisfies ``keep``."""
    idx = [i for i, n in enumerate(names) if keep(n)]
    return F.transform(F.array(*[F.lit(i) for i in idx]), lambda i: F.get(psi, i))


def target_leads(df, keys, target, horizons, ts="ts", step=HOUR, chunk=None) -> DataFrame:
    """Array ``labels``: the target at each horizon, null where that time is not observed."""
    return in_blocks(df, keys, df.columns, ["labels"], lambda b: ({"labels": b.ahead(target, horizons)}, np.ones(len(b.pos), bool)),
                     ts, 0, max([1, *horizons]), step, chunk)


def future_max(df, keys, col, hours, ts="ts", name="future_max") -> DataFrame:
    return windowed(df, keys, lambda f: {name: F.max(col).over(f.between(0, hours))}, ts, ahead=hours)


def hold_first(df, keys, col, ts="ts", name="held") -> DataFrame:
    """The first value of each key, repeated: the persistence scenario."""
    first = df.groupBy(*keys).agg(F.min_by(col, ts).alias(name))
    return df.join(first, keys)


def supervised_windows(df, keys, drivers, target, past=168, ahead=72, every=3, ts="ts") -> DataFrame:
    """Past driver rows, future driver rows and future targets as arrays; complete windows only.

    Windows are strided views of a block's dense rows, copied at the anchors (hours divisible by ``every``) alone.
    A window is complete if all its hours have a row and all its targets a value; drivers may be null.
    """
    src = df.select(*keys, ts, *dict.fromkeys([*drivers, target])).withColumn("_one", F.lit(1.0))

    def make(b):
        hour = b.table.column("_e").to_numpy() // HOUR
        here = np.concatenate([np.zeros(past), np.nan_to_num(b.dense("_one")), np.zeros(ahead)])
        known = np.concatenate([np.nan_to_num(b.dense("_one")) * np.isfinite(b.dense(target)), np.zeros(ahead)])
        rows, truths = np.concatenate([[0.0], np.cumsum(here)]), np.concatenate([[0.0], np.cumsum(known)])
        keep = (hour % every == 0) & (rows[b.pos + past + ahead] - rows[b.pos] == past + ahead) & (truths[b.pos + ahead] - truths[b.pos] == ahead)
        x = np.column_stack([b.dense(c) for c in drivers])
        x = np.vstack([np.full((past, x.shape[1]), np.nan), x, np.full((ahead, x.shape[1]), np.nan)])
        y = np.concatenate([b.dense(target), np.full(ahead, np.nan)])

        def view(a, width, shift):
            win = np.lib.stride_tricks.sliding_window_view(a, width, axis=0)
            size = width * (a.shape[1] if a.ndim > 1 else 1)
            return lambda at: np.moveaxis(win[b.pos[at] + shift], -1, 1).reshape(len(at), size)

        return {"past": view(x, past, 0), "future": view(x, ahead, past), "truth": view(y, ahead, 0)}, keep

    out = in_blocks(src, keys, src.columns[:-1], ["past", "future", "truth"], make, ts, past, ahead, HOUR, None)

    def structs(c, n):
        k = len(drivers)
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(*[F.get(c, i * k + j).alias(d) for j, d in enumerate(drivers)]))

    return out.withColumns({"past": structs("past", past), "future": structs("future", ahead)})


def standardiser(df: DataFrame, keys, cols, floor=1e-12) -> DataFrame:
    """Population mean and deviation per column; a deviation below ``floor`` becomes 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mu_{c}"),
                 F.when(F.stddev_pop(c) < floor, 1.0).otherwise(F.stddev_pop(c)).alias(f"sd_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def standardise(df: DataFrame, stats: DataFrame, keys, cols) -> DataFrame:
    j = df.join(stats, keys)
    for c in cols:
        j = j.withColumn(f"z_{c}", (F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}"))
    return j.drop(*[f"{p}_{c}" for c in cols for p in ("mu", "sd")])


def mean_of_domain_stats(df: DataFrame, domain, col) -> DataFrame:
    """Average of per-domain means and deviations (every domain counts once)."""
    per = standardiser(df, domain, [col])
    return per.agg(F.avg(f"mu_{col}").alias("mu"), F.avg(f"sd_{col}").alias("sd"))


def splice_windows(df, history, forecast, steps, lags) -> DataFrame:
    """History plus forecast, cut into the ``lags`` rows ending at each forecast step, newest first.

    ``history`` and ``forecast`` are arrays of driver arrays in time order.
    """
    seq = F.concat(history, forecast)
    out = df.withColumn("_seq", seq).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    window = F.reverse(F.slice("_seq", F.size(history) + F.col("step") - lags + 1, lags))
    return out.withColumn("window", F.flatten(window)).drop("_seq")
