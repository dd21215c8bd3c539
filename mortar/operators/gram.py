"""Additive Gram matrices: one distributed pass, p x p algebra on the driver.

``G = Z'Z`` with ``Z = [1, x_1..x_p, y]`` (values shifted by global means for numerical
stability) is a plain sum over rows, so it is computed with ordinary SQL ``sum``
aggregates (JVM, whole-stage codegen, map-side partial aggregation): the shuffle carries
one row per group and partition. For folds the rows are cut into disjoint cells (test fold and
validation folds of a row, per repeat); each cell's moments are taken about its own means and a
fold's train, validation and test moments are merged from cells. Nothing is subtracted, so a
huge value (a ratio with a zero denominator is about 1e11) in one cell leaves the others exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Centered sufficient statistics of one row set."""

    n: float
    mx: np.ndarray      # feature means (shifted coordinates)
    my: float
    sxx: np.ndarray     # sum (x - mx)(x - mx)'
    sxy: np.ndarray     # sum (x - mx)(y - my)
    syy: float


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def shift_means(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Global column means (one aggregate, p numbers to the driver) used as the shift."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0]
    return np.array([row[f"m{i}"] or 0.0 for i in range(len(cols))], dtype=float)


def gram_agg(df: DataFrame, cols: list[str], keys: list[str], shift: np.ndarray) -> DataFrame:
    """Aggregate ``n, sum z_i, sum z_i z_j`` per ``keys`` for shifted ``z = cols - shift``."""
    z = [(F.col(c).cast("double") - F.lit(float(s))) for c, s in zip(cols, shift)]
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    aggs += [F.sum(z[i]).alias(f"s{i}") for i in range(len(cols))]
    aggs += [F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in _pairs(len(cols))]
    return df.groupBy(*keys).agg(*aggs)


def collect_grams(agg: DataFrame, keys: list[str], k: int) -> dict[tuple, np.ndarray]:
    """Driver side: ``{key tuple: (k+1)x(k+1) Gram of [1, z]}`` (tiny: one row per group)."""
    out = {}
    for r in agg.collect():
        g = np.zeros((k + 1, k + 1))
        g[0, 0] = r["n"]
        for i in range(k):
            g[0, i + 1] = g[i + 1, 0] = r[f"s{i}"] or 0.0
        for i, j in _pairs(k):
            g[i + 1, j + 1] = g[j + 1, i + 1] = r[f"p{i}_{j}"] or 0.0
        out[tuple(r[c] for c in keys)] = g
    return out


def moments(g: np.ndarray) -> Moments:
    """Centered moments from a Gram of ``[1, x_1..x_p, y]`` (label last)."""
    n = g[0, 0]
    s = g[0, 1:]
    m = s / n if n > 0 else np.zeros_like(s)
    c = g[1:, 1:] - n * np.outer(m, m)
    p = len(s) - 1
    return Moments(n=n, mx=m[:p], my=m[p], sxx=c[:p, :p], sxy=c[:p, p], syy=c[p, p])


def cell_moments(df: DataFrame, cols: list[str], keys: list[str]) -> dict[tuple, Moments]:
    """Centred moments per key, about each cell's own means (two aggregates; one row per cell is collected).

    Nulls in ``keys`` are cells of their own."""
    z = [F.col(c).cast("double") for c in cols]
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    means = [r for r in df.groupBy(*named).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(z)],
                                               F.count(F.lit(1)).cast("double").alias("n")).collect()]
    if not means:
        return {}
    index = {tuple(r[f"__k{i}"] for i in range(len(keys))): j for j, r in enumerate(means)}
    rows = [(j, *k, *[r[f"m{i}"] for i in range(len(cols))]) for (k, j), r in zip(index.items(), means)]
    kinds = ["int", *[df.schema[k].dataType.simpleString() for k in keys], *["double"] * len(cols)]
    names = ["__cell", *[f"__c{i}" for i in range(len(keys))], *[f"__m{i}" for i in range(len(cols))]]
    table = df.sparkSession.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, kinds)))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__c{i}"))
    j = df.join(F.broadcast(table), on)  # as many rows as cells, which were just collected
    d = [c - F.col(f"__m{i}") for i, c in enumerate(z)]
    agg = j.groupBy("__cell").agg(*[F.sum(d[a] * d[b]).alias(f"p{a}_{b}") for a, b in _pairs(len(cols))])
    sums = {r["__cell"]: r for r in agg.collect()}
    p = len(cols) - 1
    out = {}
    for key, i in index.items():
        c = np.zeros((p + 1, p + 1))
        for a, b in _pairs(p + 1):
            c[a, b] = c[b, a] = sums[i][f"p{a}_{b}"] or 0.0
        mean = np.array([means[i][f"m{a}"] or 0.0 for a in range(p + 1)])
        out[key] = Moments(n=means[i]["n"], mx=mean[:p], my=float(mean[p]), sxx=c[:p, :p], sxy=c[:p, p], syy=float(c[p, p]))
    return out


def merge_moments(parts: list[Moments], p: int) -> Moments:
    """Moments of a union of disjoint row sets (pairwise parallel variance formula)."""
    out = Moments(n=0.0, mx=np.zeros(p), my=0.0, sxx=np.zeros((p, p)), sxy=np.zeros(p), syy=0.0)
    for m in parts:
        n = out.n + m.n
        if m.n == 0:
            continue
        dx, dy, w = m.mx - out.mx, m.my - out.my, out.n * m.n / n
        out = Moments(n=n, mx=out.mx + dx * (m.n / n), my=out.my + dy * (m.n / n),
                      sxx=out.sxx + m.sxx + w * np.outer(dx, dx), sxy=out.sxy + m.sxy + w * dx * dy,
                      syy=out.syy + m.syy + w * dy * dy)
    return out


def sse(m: Moments, a: float, beta: np.ndarray) -> float:
    """Squared error of ``a + x . beta`` over the rows of ``m``."""
    bias = m.my - a - float(m.mx @ beta)
    return max(0.0, float(m.syy - 2 * beta @ m.sxy + beta @ m.sxx @ beta)) + m.n * bias * bias


MASK_FOLDS = 12


def fold_moments(data: DataFrame, folds: DataFrame, cols: list[str]) -> dict[tuple, dict[str, Moments]]:
    """``{(regime, repeat, fold): {split: Moments}}`` for a fold table over ``data`` (``row_id, cols``, label last).

    With few folds a repeat the cells are (test fold, set of validation folds) and each row is
    in one cell a repeat; with many, validation sets hardly repeat, and the cells are the
    splits themselves."""
    p = len(cols) - 1
    layout = folds.select("regime", "repeat", "fold").distinct().collect()
    by_repeat: dict[tuple, list] = {}
    for r in layout:
        by_repeat.setdefault((r["regime"], r["repeat"]), []).append(r["fold"])
    if max((len(v) for v in by_repeat.values()), default=0) > MASK_FOLDS:
        cells = cell_moments(folds.select("regime", "repeat", "fold", "split", "row_id").join(data, "row_id"), cols,
                             ["regime", "repeat", "fold", "split"])
        out: dict[tuple, dict[str, Moments]] = {}
        for key, m in cells.items():
            out.setdefault(key[:3], {})[key[3]] = m
        return out
    marks = folds.groupBy("regime", "repeat", "row_id").agg(
        F.max(F.when(F.col("split") == "test", F.col("fold"))).alias("__test"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("split") == "val", F.col("fold"))))).alias("__val"))
    cells = cell_moments(marks.join(data, "row_id"), cols, ["regime", "repeat", "__test", "__val"])
    out = {}
    for (regime, repeat), found in by_repeat.items():
        mine = [(k[2], set(k[3].split(",")), m) for k, m in cells.items() if k[:2] == (regime, repeat)]
        for f in found:
            val = [m for t, v, m in mine if str(f) in v]
            test = [m for t, v, m in mine if t == f]
            train = [m for t, v, m in mine if t != f and str(f) not in v]
            out[(regime, repeat, f)] = {s: merge_moments(x, p) for s, x in (("train", train), ("val", val), ("test", test))}
    return out
