"""MLP regression (H19) and MLP seed ensembles (H20) by data-parallel full-batch Adam.

Rows are packed into blocks once (:mod:`mortar.operators.blocks`). Each iteration is one Spark job: a task runs
forward/backward passes on its blocks' train rows for every (fold, seed) network and emits gradient
sums; a ``groupBy`` adds them (one vector per fold, seed and partition crosses the
shuffle). The driver applies Adam with the L2 penalty and early stopping on a 15 %
hash-chosen validation part of the train rows (patience ``n_iter_no_change``). All
folds and seeds train in the same jobs. Predictions are one more pass; a seed ensemble
averages its seeds. The per-fold scaler is fitted on the train rows (as the wrapped
scaler of the study does).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortar.functions.hashing import h
from mortar.operators.blocks import Block, Blocks, pack, prediction_table


def _init(sizes, seed):
    rng = np.random.default_rng(seed)
    params = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        lim = np.sqrt(6.0 / (a + b))
        params += [rng.uniform(-lim, lim, (a, b)), rng.uniform(-lim, lim, b)]
    return params


def _flat(ps):
    return np.concatenate([p.ravel() for p in ps])


def _unflat(v, sizes):
    out, i = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append(v[i:i + a * b].reshape(a, b)); i += a * b
        out.append(v[i:i + b]); i += b
    return out


def _forward(x, ps, act):
    hs = [x]
    for li in range(0, len(ps), 2):
        z = hs[-1] @ ps[li] + ps[li + 1]
        if li + 2 < len(ps):
            z = np.maximum(z, 0.0) if act == "relu" else np.tanh(z)
        hs.append(z)
    return hs


def _backward(hs, y, ps, act):
    grads = [None] * len(ps)
    delta = (hs[-1][:, 0] - y)[:, None]
    for li in reversed(range(0, len(ps), 2)):
        grads[li] = hs[li // 2].T @ delta
        grads[li + 1] = delta.sum(0)
        if li > 0:
            d = delta @ ps[li].T
            hprev = hs[li // 2]
            delta = d * (hprev > 0) if act == "relu" else d * (1 - hprev ** 2)
    return grads


def fold_scales(b: Blocks) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fold the means and scales (constant: 1) of the features over its train rows; one pass."""
    read, train, n_folds, n_cols = b.reader(), b.train, len(b.folds), b.n_cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for block in read(batch):
                for f in range(n_folds):
                    mine = block.rows(f, train)
                    if len(mine):
                        x = block.x[:, mine]
                        d = x - x[:, :1]  # exactly 0 where a feature is constant
                        mean = d.mean(axis=1)
                        held[f] = _merged(held.get(f), (len(mine), x[:, 0] + mean, ((d - mean[:, None]) ** 2).sum(axis=1)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([float(h[0]) for h in held.values()], pa.float64()),
                                          *[pa.array([h[i] for h in held.values()], pa.list_(pa.float64())) for i in (1, 2)]],
                                         ["fold", "n", "mean", "m2"])

    out: dict[int, tuple] = {}
    for r in b.data.select("y", "x", "roles").mapInArrow(run, "fold int, n double, mean array<double>, m2 array<double>").collect():
        out[r["fold"]] = _merged(out.get(r["fold"]), (r["n"], np.array(r["mean"]), np.array(r["m2"])))  # a row per task and fold
    scale = {f: np.sqrt(m2 / n) for f, (n, _, m2) in out.items()}
    return {f: (out[f][1], np.where(sd == 0, 1.0, sd)) for f, sd in scale.items()}


def _merged(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n)


def mlp_predictions(features: DataFrame, folds: DataFrame, cols: list[str], label: str, hidden=(32,), activation="relu", alpha=1e-4,
                    lr=1e-2, max_iter=150, n_iter_no_change=25, tol=1e-4, seeds=(0,), name="MLP", feature_set="") -> DataFrame:
    """H19 / H20 on every fold of ``folds``, the inputs scaled by the fold's train rows: the prediction table."""
    sizes = [len(cols), *hidden, 1]
    b = pack(features, folds, cols, label, {"es": ((h(F.lit("es"), F.col("row_id")) % 100) < 15).cast("int")})
    scales, read, train = fold_scales(b), b.reader(), b.train
    ymean = {f: b.means[f, train][1] for f in scales}
    units = [(f, s) for f in sorted(scales) for s in seeds]
    state = {u: {"p": _flat(_init(sizes, u[1])), "m": 0.0, "v": 0.0, "t": 0, "best": np.inf, "bad": 0,
                 "best_p": None, "done": False} for u in units}
    width = len(_flat(_init(sizes, 0))) + 4  # gradient, loss, loss and rows that watch, rows fitted
    data = b.data.select("y", "x", "roles", "es")

    def scaled(block: Block, f: int, rows: np.ndarray) -> np.ndarray:
        return (block.x[:, rows].T - scales[f][0]) / scales[f][1]

    for _ in range(max_iter):
        live = {u: st["p"] for u, st in state.items() if not st["done"]}
        if not live:
            break

        def grad_part(batches: Iterator[pa.RecordBatch], live=live) -> Iterator[pa.RecordBatch]:
            total = {u: np.zeros(width) for u in live}
            for batch in batches:
                for block in read(batch):
                    for f in sorted({u[0] for u in live}):
                        rows = block.rows(f, train)
                        es = block.marks["es"][rows] > 0
                        x, y = scaled(block, f, rows), block.y[rows] - ymean[f]
                        for s in seeds:
                            if (f, s) not in live:
                                continue
                            ps = _unflat(live[f, s], sizes)
                            hs = _forward(x[~es], ps, activation)
                            loss = ((hs[-1][:, 0] - y[~es]) ** 2).sum()
                            watched = ((_forward(x[es], ps, activation)[-1][:, 0] - y[es]) ** 2).sum()
                            total[f, s] += np.concatenate([_flat(_backward(hs, y[~es], ps, activation)),
                                                           [loss, watched, es.sum(), (~es).sum()]])
            idx = np.concatenate([units.index(u) * width + np.arange(width) for u in total])
            yield pa.RecordBatch.from_arrays([pa.array(idx.astype(np.int64)), pa.array(np.concatenate(list(total.values())))], ["idx", "val"])

        sums = data.mapInArrow(grad_part, "idx long, val double").groupBy("idx").agg(F.sum("val").alias("val")).toArrow()
        flat = np.zeros(len(units) * width)  # the parameters of all networks
        flat[sums.column("idx").to_numpy()] = sums.column("val").to_numpy()
        for u in live:
            st, v = state[u], flat[units.index(u) * width: (units.index(u) + 1) * width]
            npar = len(st["p"])
            n = max(v[npar + 3], 1)
            ps = _unflat(st["p"], sizes)
            reg = _flat([alpha * p if i % 2 == 0 else np.zeros_like(p) for i, p in enumerate(ps)])
            grad = (v[:npar] + reg) / n
            st["t"] += 1
            st["m"] = 0.9 * st["m"] + 0.1 * grad
            st["v"] = 0.999 * st["v"] + 0.001 * grad * grad
            mh = st["m"] / (1 - 0.9 ** st["t"])
            vh = st["v"] / (1 - 0.999 ** st["t"])
            st["p"] = st["p"] - lr * mh / (np.sqrt(vh) + 1e-8)
            val_loss = v[npar + 1] / max(v[npar + 2], 1.0)
            if val_loss < st["best"] - tol:
                st["best"], st["bad"], st["best_p"] = val_loss, 0, st["p"].copy()
            else:
                st["bad"] += 1
                if st["bad"] >= n_iter_no_change:
                    st["done"] = True
    final = {u: (st["best_p"] if st["best_p"] is not None else st["p"]) for u, st in state.items()}

    def predict(batch: pa.RecordBatch, i: int, block: Block, f: int, rows: np.ndarray) -> list[np.ndarray]:
        if f not in scales:
            return [np.full(len(rows), np.nan)]
        x = scaled(block, f, rows)
        return [ymean[f] + np.mean([_forward(x, _unflat(final[f, s], sizes), activation)[-1][:, 0] for s in seeds], axis=0)]

    return prediction_table(b, b.data, predict, [name], feature_set)
