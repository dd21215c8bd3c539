"""Sampled leave-one-out metrics by downdates against a refit of every sampled fold."""

import hashlib

import numpy as np
import pytest

from mortar.operators.loo import loo_sampled_metrics


def refitted(ids, x, y, every, seed):
    """Pooled actual and predicted values of both splits, each fold fitted anew."""
    order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"{seed}:loo:{ids[i]}".encode()).hexdigest()[:8], ids[i]))
    most = max(1, round(0.2 * (len(ids) - 1)))
    out = {"train": ([], []), "val": ([], [])}
    one = np.column_stack([np.ones(len(ids)), x])
    for i in np.argsort(ids)[::every]:
        rest = [j for j in order if j != i]
        parts = {"val": rest[:most], "train": rest[most:]}
        beta = np.linalg.lstsq(one[parts["train"]], y[parts["train"]], rcond=None)[0]
        for split, rows in parts.items():
            out[split][0].append(y[rows])
            out[split][1].append(one[rows] @ beta)
    return {s: tuple(np.concatenate(v) for v in pair) for s, pair in out.items()}


@pytest.mark.parametrize("n,every", [(60, 8), (61, 3), (24, 1)])
def test_downdates_equal_refits(spark, n, every):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3)) * [1.0, 40.0, 0.01] + [0.0, 500.0, 3.0]
    y = x @ [2.0, 0.1, 90.0] + rng.normal(size=n) * 3
    ids = rng.permutation(10 * n)[:n]
    rows = [(int(i), *map(float, r), float(v)) for i, r, v in zip(ids, x, y, strict=True)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y double")
    got = {r["split"]: r for r in loo_sampled_metrics(df, ["a", "b", "c"], "y", every, 4).collect()}
    for split, (actual, predicted) in refitted(ids, x, y, every, 4).items():
        err = predicted - actual
        r = got[split]
        assert r["n"] == len(err)
        assert np.allclose([r["MSE"], r["RMSE"], r["R2"], r["VAF"], r["STD"]],
                           [np.mean(err**2), np.sqrt(np.mean(err**2)), 1 - (err**2).sum() / ((actual - actual.mean())**2).sum(),
                            100 * (1 - err.var() / actual.var()), err.std()], rtol=1e-8)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_nulls_without_a_fold(spark, n):
    df = spark.createDataFrame([(i, 1.0 * i, 2.0) for i in range(n)], "row_id long, a double, y double")
    rows = loo_sampled_metrics(df, ["a"], "y").collect()
    assert [(r["split"], r["n"], r["MSE"], r["R2"]) for r in rows] == [("train", 0, None, None), ("val", 0, None, None)]
