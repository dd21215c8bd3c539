"""Whitening of embeddings by incremental eigendecomposition.

*Updates.* Every task starts from an empty spectrum and adds one centred vector after the other: the
spectrum of ``Q diag(d) Q' + rho z z'`` follows from the roots of a secular equation. Directions that
``z`` hardly touches, and all but one direction of an equal eigenvalue (after a reflection that
turns ``z`` into it), are deflated. Eigenvectors come from weights recomputed out of the roots, which
keeps them orthogonal.

*Combining.* A task's spectrum, ``d`` pairs whatever its number of rows, is added to another's as ``d``
rank-one updates. Spectra meet in groups of ``FAN_IN``, level by level, until one is left.

*Refinement.* In the basis found, the covariance is summed once more over all rows, centred before
multiplying (Rayleigh-Ritz over the whole basis), which gives the components to double precision.
A last sum measures the whitened covariance.

What reaches the driver, and each task, is ``d`` sums and ``d x d`` matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortar.llm.common import saved

SCALE, SHIFT = 1024, 100_000  # the contract's integer grid
FAN_IN = 8
EPS = np.finfo(float).eps
FLAT = 1e-12  # below this share of the trace an eigenvalue counts as none


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z2 / (d - x))``, one above each pole of the rising ``d``.

    Returned as (index of the nearer pole, distance from it), which keeps differences to poles exact.
    All roots are searched at once: a step of the two-pole rational model that holds the sums left and
    right of the root, and bisection where that leaves the bracket."""
    k = len(d)
    gap = np.append(np.diff(d), rho * z2.sum())
    poles = d[None, :] - d[:, None]  # from pole i
    middle = 1 + rho * (z2 / (poles - gap[:, None] / 2)).sum(axis=1)
    origin = np.where((middle >= 0) | (np.arange(k) == k - 1), np.arange(k), np.arange(k) + 1)
    from_left = origin == np.arange(k)
    poles = d[None, :] - d[origin][:, None]
    lo = np.where(from_left, 0.0, -gap / 2)
    hi = np.where(from_left, np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
    left = np.arange(k)[None, :] <= np.arange(k)[:, None]
    near, far = poles[np.arange(k), np.arange(k)], poles[np.arange(k), np.minimum(np.arange(k) + 1, k - 1)]
    end = np.arange(k) == k - 1
    x = (lo + hi) / 2
    for _ in range(80):
        gaps = poles - x[:, None]
        terms = rho * z2 / gaps
        value = 1 + terms.sum(axis=1)
        lo, hi = np.where(value < 0, x, lo), np.where(value >= 0, x, hi)
        slopes = terms / gaps
        a1 = np.where(left, slopes, 0.0).sum(axis=1)
        a2 = slopes.sum(axis=1) - a1
        # value(y) ~ c + s / (near - y) + t / (far - y), equal in value and in both slopes at x
        n0, f0 = near - x, far - x
        s, t = a1 * n0 * n0, np.where(end, 0.0, a2 * f0 * f0)
        c = value - a1 * n0 - np.where(end, 0.0, a2 * f0)
        # c (n0 - y)(f0 - y) + s (f0 - y) + t (n0 - y) = 0, y the step
        b = -(c * (n0 + f0) + s + t)
        e = c * n0 * f0 + s * f0 + t * n0
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(b * b - 4 * c * e, 0.0))
            step = np.where(b <= 0, 2 * e / (-b + root), (-b - root) / (2 * c))
            step = np.where(end, n0 + s / c, step)
            y = x + step
        tried = np.isfinite(y) & (y > lo) & (y < hi)
        new = np.where(tried, y, (lo + hi) / 2)
        settled = np.abs(value) <= 4 * EPS * (1 + np.abs(terms).sum(axis=1))  # no sign left to go by
        settled |= np.abs(new - x) <= 4 * EPS * np.abs(new)
        x = np.where(settled, x, new)
        if settled.all():
            break
    return origin, x


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``q diag(d) q' + rho v v'`` (``d`` rising, ``q`` orthogonal, ``rho`` > 0)."""
    z = q.T @ v
    size = max(abs(d[-1]), rho * float(v @ v))
    if size == 0.0:
        return d, q
    tol = 8 * EPS * size
    start = np.flatnonzero(np.append(True, np.diff(d) > tol))
    stop = np.append(start[1:], len(d))
    q = q.copy()
    for a, b in zip(start, stop):  # equal eigenvalues: turn z into the cluster's last direction
        if b - a > 1 and np.abs(z[a:b - 1]).max() > 0:
            w = z[a:b].copy()
            w[-1] += np.copysign(np.linalg.norm(w), w[-1])
            w /= np.linalg.norm(w)
            z[a:b] -= 2 * w * (w @ z[a:b])
            q[:, a:b] -= np.outer(q[:, a:b] @ w, 2 * w)
            z[a:b - 1] = 0.0
    live = np.flatnonzero(rho * np.abs(z) * np.linalg.norm(z) > tol)
    if len(live) == 0:
        return d, q
    poles, z2 = d[live], z[live] ** 2
    origin, offset = secular_roots(poles, z2, rho)
    diff = (poles[:, None] - poles[origin][None, :]) - offset[None, :]  # pole i minus root j
    # Weights that have exactly these roots (they keep the eigenvectors orthogonal).
    ratio = -diff / np.where(np.eye(len(live), dtype=bool), 1.0, poles[:, None] - poles[None, :])
    exact = np.abs(np.prod(ratio, axis=1)) / rho
    vectors = np.copysign(np.sqrt(exact), z[live])[:, None] / diff
    vectors /= np.linalg.norm(vectors, axis=0)
    new_d, new_q = d.copy(), q
    new_d[live] = poles[origin] + offset
    new_q[:, live] = q[:, live] @ vectors
    order = np.argsort(new_d, kind="stable")
    return new_d[order], np.ascontiguousarray(new_q[:, order])


def combined(spectra: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of the sum of several, by a rank-one update for every pair of the later ones."""
    d, q = spectra[0]
    for other_d, other_q in spectra[1:]:
        for value, vector in zip(other_d[::-1], other_q.T[::-1]):
            if value > 0:
                d, q = rank_one(d, q, vector, value)
    return d, q


def grid(column: pa.Array) -> np.ndarray:
    """The rows of a fixed-length list column as integers ``floor(1024 c) + 100000``."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * values).astype(np.int64) + SHIFT).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """``(key, c)`` with c an array of doubles, without null, empty, and not wholly finite vectors.

    Vectors of another length than the most common one (of equally common ones the longest) cannot share a
    covariance and are left out."""
    cells = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("c"))
    fine = cells.where(F.col("c").isNotNull() & (F.size("c") > 0) & F.forall(
        "c", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    lengths = fine.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return fine, 0
    dims = lengths[0]["size"]
    return fine.where(F.size("c") == dims), dims


def summed(rows: DataFrame, size: int, kind: str, per_batch: Callable) -> np.ndarray:
    """The sum over all rows of ``per_batch(x)``, ``size`` numbers: one row for each task and number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64 if kind == "long" else np.float64)
        for b in batches:
            if b.num_rows:
                total += per_batch(grid(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    per_task = rows.select("c").mapInArrow(run, f"at int, value {kind}")
    found = per_task.groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in found:
        out[r["at"]] = r["value"]
    return out


def spectrum(rows: DataFrame, dims: int, mean: np.ndarray, fan_in: int = FAN_IN) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of the sum of centred outer products over all rows."""
    fields = "task long, d array<double>, q array<double>"

    def packed(task: int, d: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([d.tolist()], pa.list_(pa.float64())),
                                           pa.array([q.ravel().tolist()], pa.list_(pa.float64()))], ["task", "d", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        d, q, any_row = np.zeros(dims), np.eye(dims), False
        for b in batches:
            for x in grid(b.column(0)) if b.num_rows else ():
                d, q = rank_one(d, q, x - mean)
                any_row = True
        if any_row:
            yield packed(TaskContext.get().partitionId(), d, q)

    def merge(key, pdf):
        pdf = pdf.sort_values("task")
        d, q = combined([(np.array(r.d), np.array(r.q).reshape(dims, dims)) for r in pdf.itertuples()])
        return pd.DataFrame({"task": [int(key[0])], "d": [d.tolist()], "q": [q.ravel().tolist()]})

    level = saved(rows.select("c").mapInArrow(run, fields))
    # Tasks are numbered densely by their rank, a few numbers each; later levels divide it.
    while (count := level.count()) > 1:
        width = max(1, -(-count // fan_in))
        level = saved(level.groupBy(F.pmod(F.col("task"), F.lit(width)).alias("g")).applyInPandas(merge, fields))
    last = level.collect()[0]
    return np.array(last["d"]), np.array(last["q"]).reshape(dims, dims)


def components(rows: DataFrame, dims: int, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and unit eigenvectors (columns), to double precision."""
    mean = sums / n
    _, basis = spectrum(rows, dims, mean)

    def projected(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ basis
        return (z.T @ z).ravel()

    ritz = summed(rows, dims * dims, "double", projected).reshape(dims, dims) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(-values, kind="stable")
    vectors, _ = np.linalg.qr((basis @ turn)[:, order])  # back to unit length where rounding has crept in
    return np.maximum(values[order], 0.0), vectors


def exact_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """``sum((n x - S)^2)`` of each row as whole numbers of any size."""
    away = n * x - sums
    if np.abs(away).max(initial=0) < 3e9 / max(1, x.shape[1]) ** 0.5:
        return (away * away).sum(axis=1).tolist()
    high, low = away >> 20, away & ((1 << 20) - 1)  # away = high 2^20 + low: three sums that fit, while |away| < 2^46
    if np.abs(high).max(initial=0) < (1 << 26):
        parts = (high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)
        return [(int(a) << 40) + (int(b) << 21) + int(c) for a, b, c in zip(*parts)]
    return [sum(v * v for v in row) for row in away.tolist()]


def whiten(vectors: DataFrame, n_components: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per usable vector and component: ``key, component, n, deviation, deviation_exact, whitened, explained, identity_error``.

    Null, empty and not wholly finite vectors have no rows (nor have those of another length than most); a
    null key is kept; repeated rows each count and each have rows; a component without variance has
    whitened 0; an empty table gives an empty one; other columns are not read. ``deviation`` is null where it
    passes 2^63 - 1; ``deviation_exact`` holds it as a decimal of 38 digits."""
    rows, dims = usable(vectors, key, column)
    kind = vectors.schema[key].dataType.simpleString()
    out = (f"key {kind}, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, "
           "explained double, identity_error double")
    shape = ["key", "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"]
    if not dims:
        return rows.sparkSession.createDataFrame([], out).withColumnRenamed("key", key)
    totals = summed(rows, dims + 1, "long", lambda x: np.append(x.sum(axis=0), len(x)))
    n, sums = int(totals[-1]), totals[:-1]
    values, vecs = components(rows, dims, n, sums)
    k = min(n_components, dims)
    trace = float(values.sum())
    live = values[:k] > FLAT * trace
    scale = np.where(live, 1 / np.sqrt(np.where(live, values[:k], 1.0)), 0.0)
    project = vecs[:, :k] * scale
    mean = sums / n

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ project
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    found = summed(rows, k * k + k, "double", moments) / n
    centre = found[k * k:]
    cov = found[: k * k].reshape(k, k) - np.outer(centre, centre)  # the centre is 0 but for rounding
    error = float(np.abs(cov - np.eye(k)).max())
    explained = values[:k] / trace if trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                x, m = grid(b.column(1)), b.num_rows
                exact = exact_deviation(x, n, sums)
                fits = [v if v < 1 << 63 else None for v in exact]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(fits, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(exact, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error))], shape)

    return rows.select("key", "c").mapInArrow(run, out).withColumnRenamed("key", key)
