"""Models on per-fold expanded features (H5 Ridge+Poly, H8 GP, H9 SVR) via wide Grams.

The written table has one row per data row: its raw features and the (fold, split) roles it
has. The scaler is fitted on each fold's train rows (one aggregate). Tasks standardise a batch
of rows for a fold and expand it in NumPy (polynomial products, or random Fourier features
``sqrt(2/D) cos(Wz + b)``, Rahimi & Recht 2007), so expanded rows are never written or shuffled.
Gram matrices ``Z'WZ`` are summed per fold (the shuffle carries one upper triangle per task
and fold). The p x p (here D x D) solves run on the driver; the predictions are one more pass.

* Ridge+Poly: ridge on polynomial features of the standardised inputs (exact).
* Gaussian process C*RBF + White, normalize_y: Bayesian linear regression on RFF features
  with the given length scale and noise (approximate: no marginal-likelihood refit).
* SVR (RBF): epsilon-insensitive loss on RFF features by iteratively reweighted least
  squares, each round one weighted Gram pass over all folds at once (approximate).
"""

from __future__ import annotations

import math

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.functions.features import poly_terms
from mortar.session import materialize, row_side

KEYS = ["regime", "repeat", "fold"]
CHUNK = 4_000  # rows expanded at once

Expand = Callable[[np.ndarray], np.ndarray]
Fit = tuple[float, np.ndarray]


def fold_scalers(features: DataFrame, folds: DataFrame, cols: list[str]) -> DataFrame:
    tr = folds.where(F.col("split") == "train").join(features.select("row_id", *cols), "row_id")
    aggs = [F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)]
    aggs += [F.stddev_pop(c).alias(f"__s{i}") for i, c in enumerate(cols)]
    return tr.groupBy(*KEYS).agg(*aggs)


def scaled_frame(features: DataFrame, folds: DataFrame, cols: list[str], label: str) -> tuple[DataFrame, list[Column]]:
    sc = fold_scalers(features, folds, cols)
    j = folds.join(features.select("row_id", *cols, F.col(label).alias("actual")), "row_id").join(F.broadcast(sc), KEYS)
    zs = [(F.col(c) - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"__s{i}"))
          for i, c in enumerate(cols)]
    return j, zs


def poly_expand(n_cols: int, degree: int = 2, interaction_only: bool = False) -> tuple[Expand, int]:
    """Polynomial terms of standardised rows, and how many there are."""
    terms = [[int(i) for i in t] for t in poly_terms([str(i) for i in range(n_cols)], degree, interaction_only)]
    return lambda z: np.column_stack([z[:, t].prod(axis=1) for t in terms]), len(terms)


def rff_expand(n_cols: int, length_scale: float, d: int = 64, seed: int = 0) -> tuple[Expand, int]:
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, 1.0 / length_scale, size=(d, n_cols))
    b = rng.uniform(0.0, 2 * math.pi, size=d)
    scale = math.sqrt(2.0 / d)
    return lambda z: scale * np.cos(b + z @ w.T), d


class Frame:
    """Rows ``row_id, actual, x, roles``; a role is a position in ``layout`` (``regime, repeat, fold, split``).

    ``stats``: per role the mean target and the means and scales (constant: 1) of the features;
    ``train``: the role of each fold's train rows. A row with copies holds each of its roles as often as they do."""

    def __init__(self, features: DataFrame, folds: DataFrame, cols: list[str], label: str):
        self.n_cols, names = len(cols), [*KEYS, "split"]
        self.kinds = ", ".join(f"{c} {t}" for c, t in folds.select(*names).dtypes)
        self.layout = sorted(tuple(r) for r in folds.select(*names).distinct().collect())
        table = folds.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(self.layout)], self.kinds + ", role int")
        held = folds.join(F.broadcast(table), names).groupBy("row_id").agg(F.collect_list("role").alias("roles"))
        data = features.select("row_id", F.col(label).cast("double").alias("actual"),
                               F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
        self.rows = materialize(data.join(row_side(held), "row_id"))
        x = [F.col("x")[i] for i in range(self.n_cols)]
        found = self.rows.select("actual", "x", F.explode("roles").alias("role")).groupBy("role").agg(
            F.avg("actual").alias("y"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).collect()  # one row per (fold, split)
        self.stats = {}
        for r in found:
            mean, sd = (np.array([r[f"{n}{i}"] for i in range(self.n_cols)], float) for n in "ms")
            self.stats[r["role"]] = (r["y"], mean, np.where(sd == 0, 1.0, sd))
        self.train = {r[:3]: i for i, r in enumerate(self.layout) if r[3] == "train"}

    def fold_of(self, role: int) -> tuple:
        return self.layout[role][:3]


def _parts(batches: Iterator[pa.RecordBatch], scalers: dict[int, tuple], expand: Expand) -> Iterator[tuple]:
    """``(role, rows of the batch, their target, their expanded features)`` for the roles in ``scalers``."""
    for whole in batches:
        for a in range(0, whole.num_rows, CHUNK):
            b = whole.slice(a, CHUNK)
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            y = b.column("actual").to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(b)), np.diff(b.column("roles").offsets.to_numpy()))
            roles = b.column("roles").flatten().to_numpy()
            for role in np.unique(roles).tolist():
                if role in scalers:
                    mine = at[roles == role]
                    yield role, b.column("row_id").take(pa.array(mine)), y[mine], expand((x[mine] - scalers[role][0]) / scalers[role][1])


def wide_grams(frame: Frame, expand: Expand, width: int, weigh: Callable | None = None) -> dict[tuple, np.ndarray]:
    """``[1, e, y]' W [1, e, y]`` over each fold's train rows; ``weigh(role, e, y)``: the rows' weights."""
    k = width + 2
    upper = np.triu_indices(k)
    scalers = {i: frame.stats[i][1:] for i in frame.train.values()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for role, _, y, e in _parts(batches, scalers, expand):
            z = np.column_stack([np.ones(len(y)), e, y])
            wz = z if weigh is None else z * weigh(role, e, y)[:, None]
            total[role] = total.get(role, 0.0) + z.T @ wz
        for role, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(upper[0]), role, np.int32)), pa.array(np.arange(len(upper[0]), dtype=np.int32)),
                 pa.array(m[upper])], ["role", "idx", "val"])

    sums = frame.rows.select("row_id", "actual", "x", "roles").mapInArrow(run, "role int, idx int, val double").groupBy(
        "role", "idx").agg(F.sum("val").alias("val"))
    out: dict[tuple, np.ndarray] = {}
    for r in sums.collect():  # one upper triangle per fold: bounded by folds x D^2
        out.setdefault(frame.fold_of(r["role"]), np.zeros((k, k)))[upper[0][r["idx"]], upper[1][r["idx"]]] = r["val"]
    return {key: m + np.triu(m, 1).T for key, m in out.items()}


def _ridge_from_gram(g: np.ndarray, lam: float, intercept: bool = True) -> tuple[float, np.ndarray]:
    n = g[0, 0]
    d = g.shape[0] - 2
    if intercept:
        mx, my = g[0, 1:d + 1] / n, g[0, d + 1] / n
        sxx = g[1:d + 1, 1:d + 1] - n * np.outer(mx, mx)
        sxy = g[1:d + 1, d + 1] - n * mx * my
        beta = np.linalg.solve(sxx + lam * np.eye(d), sxy)
        return float(my - mx @ beta), beta
    beta = np.linalg.solve(g[1:d + 1, 1:d + 1] + lam * np.eye(d), g[1:d + 1, d + 1])
    return 0.0, beta


def _predict(frame: Frame, expand: Expand, coefs: dict[tuple, Fit], name: str, feature_set: str) -> DataFrame:
    """The prediction table of every fold that has a fit, with the mean target of each (fold, split)."""
    fits = {i: coefs[r[:3]] for i, r in enumerate(frame.layout) if r[:3] in coefs}
    scalers = {i: frame.stats[frame.train[frame.fold_of(i)]][1:] for i in fits}
    kind = frame.rows.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for role, ids, y, e in _parts(batches, scalers, expand):
            b0, beta = fits[role]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), role, np.int32)), ids, pa.array(y), pa.array(b0 + e @ beta)],
                                             ["role", "row_id", "actual", "predicted"])

    found = frame.rows.select("row_id", "actual", "x", "roles").mapInArrow(
        run, f"role int, row_id {kind}, actual double, predicted double")
    table = found.sparkSession.createDataFrame([(*frame.layout[i], i, frame.stats[i][0]) for i in fits],
                                               frame.kinds + ", role int, __ybar double")
    return found.join(F.broadcast(table), "role").select(  # one row for each (fold, split)
        F.lit(name).alias("model"), F.lit(feature_set).alias("feature_set"), *KEYS, "split", "row_id", "actual", "predicted", "__ybar")


def ridge_poly_predictions(features, folds, cols, label, feature_set, degree=2, alpha=1.0, interaction_only=False):
    """H5: scaler -> polynomial (no bias) -> ridge(alpha), all fitted on the fold's train rows."""
    frame = Frame(features, folds, cols, label)
    expand, width = poly_expand(len(cols), degree, interaction_only)
    coefs = {k: _ridge_from_gram(g, alpha) for k, g in wide_grams(frame, expand, width).items()}
    return _predict(frame, expand, coefs, "Ridge+Poly", feature_set)


def gp_predictions(features, folds, cols, label, feature_set, length_scale=3.0, noise_level=0.1, alpha=1e-6,
                   d=64, seed=0):
    """H8: GP mean via Bayesian linear regression on RFF features, y normalised on train."""
    frame = Frame(features, folds, cols, label)
    expand, dd = rff_expand(len(cols), length_scale, d, seed)
    coefs = {}
    for k, g in wide_grams(frame, expand, dd).items():
        n = g[0, 0]
        my = g[0, dd + 1] / n
        sy = math.sqrt(max(g[dd + 1, dd + 1] / n - my * my, 1e-300))
        # normalised target: y_n = (y - my) / sy ; Z'y_n = (Z'y - my Z'1) / sy
        zty = (g[1:dd + 1, dd + 1] - my * g[0, 1:dd + 1]) / sy
        w = np.linalg.solve(g[1:dd + 1, 1:dd + 1] + (noise_level + alpha) * np.eye(dd), zty)
        coefs[k] = (my, sy * w)
    return _predict(frame, expand, coefs, "GaussianProcess", feature_set)


def svr_predictions(features, folds, cols, label, feature_set, C=10.0, gamma=0.1, epsilon=0.1, d=64, rounds=8,
                    seed=0, delta=1e-3):
    """H9: epsilon-insensitive RFF regression by IRLS; each round is one weighted Gram pass."""
    frame = Frame(features, folds, cols, label)
    expand, width = rff_expand(len(cols), 1.0 / math.sqrt(2.0 * gamma), d, seed)
    coefs = {k: _ridge_from_gram(g, 1.0 / C) for k, g in wide_grams(frame, expand, width).items()}
    for _ in range(rounds):
        fits = {frame.train[k]: fit for k, fit in coefs.items()}

        def weigh(role: int, e: np.ndarray, y: np.ndarray, fits=fits) -> np.ndarray:
            r = np.abs(y - (fits[role][0] + e @ fits[role][1]))
            return np.where(r <= epsilon, delta, 1.0 / np.maximum(r - epsilon, delta))

        coefs = {k: _ridge_from_gram(g, 1.0 / C) for k, g in wide_grams(frame, expand, width, weigh).items()}
    return _predict(frame, expand, coefs, "SVR_RBF", feature_set)
