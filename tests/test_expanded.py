"""Models on expanded features: equal to NumPy, copies included, and no expanded row is written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mortar.operators import expanded as X
from mortar.operators import splits as S
from mortar.session import materialize


@pytest.mark.parametrize("copies", [1, 2])
def test_ridge_poly_equals_numpy_and_writes_raw_rows(spark, monkeypatch, copies):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), 1.0, float(a * b + a - b + e)) for i, (a, b, e) in enumerate(rng.normal(size=(60, 3)))]
    data = spark.createDataFrame([r for r in rows for _ in range(copies)], "row_id long, a double, b double, c double, y double")
    tests = spark.createDataFrame([(0, i, i % 3) for i in range(60)], "repeat int, row_id long, fold int")
    folds = materialize(S.inner_random_split(tests, 3))
    written = []
    monkeypatch.setattr(X, "materialize", lambda df, *a, **kw: written.append(df) or materialize(df, *a, **kw))
    pred = X.ridge_poly_predictions(data, folds, ["a", "b", "c"], "y", "f", 2, 1.0).collect()
    assert [len(df.columns) for df in written] == [4] and written[0].count() == 60 * copies

    split = {(r["fold"], r["row_id"]): r["split"] for r in folds.collect()}
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    want = {}
    for f in range(3):
        tr = np.array([split[f, i] == "train" for i in range(60)])
        sd = x[tr].std(axis=0)
        z = (x - x[tr].mean(axis=0)) / np.where(sd == 0, 1, sd)
        e = np.column_stack([z, *[z[:, i] * z[:, j] for i in range(3) for j in range(i, 3)]])
        mx, my = e[tr].mean(axis=0), y[tr].mean()
        beta = np.linalg.solve(copies * (e[tr] - mx).T @ (e[tr] - mx) + np.eye(9), copies * (e[tr] - mx).T @ (y[tr] - my))
        want.update({(f, i): my + (e[i] - mx) @ beta for i in range(60)})
    assert len(pred) == 180 * copies
    for r in pred:
        assert r["split"] == split[r["fold"], r["row_id"]] and r["predicted"] == pytest.approx(want[r["fold"], r["row_id"]], abs=1e-8)


def test_target_means_are_those_of_the_rows(spark):
    data = spark.range(40).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("y"))
    tests = data.select(F.lit(0).alias("repeat"), "row_id", (F.col("row_id") % 2).cast("int").alias("fold"))
    pred = X.svr_predictions(data, S.inner_random_split(tests, 2), ["a"], "y", "f", d=4, rounds=1)
    for r in pred.groupBy("fold", "split").agg(F.avg("actual").alias("m"), F.min("__ybar").alias("a"), F.max("__ybar").alias("b")).collect():
        assert r["m"] == pytest.approx(r["a"]) and r["a"] == r["b"]
