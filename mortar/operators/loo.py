"""Train and validation metrics of sampled leave-one-out folds (E8, G13) without refits.

Every ``every``-th leave-one-out fold fits OLS on its inner train rows and is scored on them and on
its inner validation rows; the metrics pool all of these. One hash order of all rows gives every
fold's inner split: its first ``max(1, round(0.2 (n - 1)))`` rows, the fold's own row left out, are
its validation rows. So a fold's train part is the common one without one row, and its fit is a
rank-one downdate. Errors over a whole part are linear and quadratic forms in that row: one pass
over the sampled rows, where refitting would read n rows for each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.functions.hashing import order_key
from mortar.operators import linear
from mortar.operators.gram import collect_grams, gram_agg, shift_means
from mortar.operators.rank import rank_by_numeric
from mortar.operators.splits import _hash_assign
from mortar.session import materialize

SCHEMA = "split string, n long, MSE double, RMSE double, R2 double, VAF double, STD double"


def _linear(weights: np.ndarray, x: list[Column]) -> Column:
    return sum((F.lit(float(w)) * c for w, c in zip(weights, x, strict=True)), F.lit(0.0))


def _quadratic(a: np.ndarray, x: list[Column]) -> Column:
    return sum((F.lit(float(a[i, j] * (1 if i == j else 2))) * x[i] * x[j]
                for i in range(len(x)) for j in range(i, len(x))), F.lit(0.0))


def _inverse(g: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a Gram of ``[1, z]``, its rank judged on scaled columns."""
    d = 1 / np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    w, v = np.linalg.eigh(g * np.outer(d, d))
    keep = w > linear.PINV_RTOL * w.max()
    return ((v[:, keep] / w[keep]) @ v[:, keep].T) * np.outer(d, d)


def _metrics(split: str, n: int, sse: float, err: float, y: float, yy: float) -> tuple:
    if not n:
        return (split, 0, None, None, None, None, None)
    mse, sst = sse / n, yy - y * y / n
    var = max(0.0, mse - (err / n) ** 2)
    r2 = None if n < 2 else (1 - sse / sst if sst > 0 else float(sse == 0))
    return (split, int(n), mse, mse ** 0.5, r2, 100 * (1 - var * n / sst) if sst > 0 else None, var ** 0.5)


def loo_sampled_metrics(features: DataFrame, cols: list[str], label: str, every: int = 8, seed: int = 0) -> DataFrame:
    """G13 of OLS: ``split, n, MSE, RMSE, R2, VAF, STD`` for ``train`` and ``val``, nulls if no fold is sampled.

    Metrics of absolute errors (MAE, LMI, EAE) have no such closed form and are not given. A sampled
    row that its train part can't be fitted without (leverage 1) is left out, as are folds of a table
    too small for a train part. ``row_id`` is unique; features and label hold no nulls."""
    spark = features.sparkSession
    data = features.select("row_id", *cols, label)
    order = _hash_assign(data.select("row_id", F.lit(0).alias("repeat")), order_key(F.lit(seed), F.lit("loo"), F.col("row_id")),
                         "row_id", ["repeat"], lambda r, n: r, "pos").select("row_id", "pos")
    rows = materialize(rank_by_numeric(data, "row_id", out="fold").join(order, "row_id"))
    n, p = rows.count(), len(cols)
    most = max(1, round(0.2 * (n - 1)))
    last = rows.where(F.col("pos") == most).first()
    if last is None or n - most - 1 <= p:
        return spark.createDataFrame([_metrics(s, 0, 0, 0, 0, 0) for s in ("train", "val")], SCHEMA)
    shift = shift_means(data, cols + [label])
    grams = collect_grams(gram_agg(rows.withColumn("inner", F.col("pos") < most), cols + [label], ["inner"], shift),
                          ["inner"], p + 1)
    train, val = grams[(False,)], grams[(True,)]
    inv = _inverse(train[:-1, :-1])
    beta = inv @ train[:-1, -1]

    def sums(g: np.ndarray, b: np.ndarray) -> list[float]:
        """Rows, squared error, error, label and squared label over the rows of a Gram."""
        c = np.append(b, -1.0)
        return [g[0, 0], float(c @ g @ c), float(g[0] @ c), g[0, -1], g[-1, -1]]

    # folds whose row is a train row: that row leaves the fit
    x = [F.lit(1.0)] + [F.col(c).cast("double") - F.lit(float(s)) for c, s in zip(cols, shift)]
    y = F.col(label).cast("double") - F.lit(float(shift[-1]))
    resid, rest = y - _linear(beta, x), F.lit(1.0) - _quadratic(inv, x)
    step = F.when(rest > 1e-9, resid / rest)
    c0, cut = np.append(beta, -1.0), val[:-1, :-1]
    t, v = sums(train, beta), sums(val, beta)
    own = [F.lit(t[0] - 1), F.lit(t[1]) - resid * F.col("__s"), F.lit(0.0), F.lit(t[3]) - y, F.lit(t[4]) - y * y,
           F.lit(v[0]),
           F.lit(v[1]) - 2 * F.col("__s") * _linear(inv @ (val @ c0)[:-1], x)
           + F.col("__s") * F.col("__s") * _quadratic(inv @ cut @ inv, x),
           F.lit(v[2]) - F.col("__s") * _linear(inv @ cut[0], x), F.lit(v[3]), F.lit(v[4])]
    # folds whose row is a validation row: the next row of the order takes its place
    z = np.array([1.0] + [float(last[c]) - s for c, s in zip(cols, shift)] + [float(last[label]) - shift[-1]])
    fewer, more = train - np.outer(z, z), val + np.outer(z, z)
    other = _inverse(fewer[:-1, :-1]) @ fewer[:-1, -1]
    err = _linear(other, x) - y
    t, v = sums(fewer, other), sums(more, other)
    swapped = [F.lit(a) for a in t] + [F.lit(v[0] - 1), F.lit(v[1]) - err * err, F.lit(v[2]) - err,
                                       F.lit(v[3]) - y, F.lit(v[4]) - y * y]
    sampled = rows.where(F.col("fold") % every == 0).withColumn("__s", step).where(
        (F.col("pos") < most) | F.col("__s").isNotNull())
    total = sampled.agg(*[F.coalesce(F.sum(F.when(F.col("pos") < most, b).otherwise(a)), F.lit(0.0)).alias(f"s{i}")
                          for i, (a, b) in enumerate(zip(own, swapped, strict=True))]).first()
    return spark.createDataFrame([_metrics("train", *total[:5]), _metrics("val", *total[5:])], SCHEMA)
