"""Saved champions: own and Spark's models within one saved pipeline."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor

from mortar.operators.pipeline import GramRegression, load_champion
from mortar.session import scratch_dir


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, float(a), float(b), float(3 * a - b + 5)) for i, (a, b) in
                                  enumerate(rng.normal(size=(200, 2)))], "row_id long, a double, b double, y double")


def test_linear_and_tree_stages_come_back(spark, rows):
    stages = [GramRegression(["a", "b"], "y", "Linear Regression", prediction="line"),
              VectorAssembler(inputCols=["a", "b", "line"], outputCol="features"),
              RandomForestRegressor(labelCol="y", numTrees=5, seed=1, predictionCol="forest")]
    fitted = Pipeline(stages=stages).fit(rows)
    path = scratch_dir(spark, "test-champion")
    fitted.write().overwrite().save(path)
    want = {r["row_id"]: (r["line"], r["forest"]) for r in fitted.transform(rows).collect()}
    got = load_champion(spark, path).transform(rows).collect()
    assert {r["row_id"]: (r["line"], r["forest"]) for r in got} == want
    assert all(abs(r["line"] - r["y"]) < 1e-9 for r in got)


def test_null_features_and_errors(spark, rows):
    model = GramRegression(["a", "b"], "y", "Ridge", {"alpha": 0.5}).fit(rows)
    empty = spark.createDataFrame([(1, None, 2.0)], "row_id long, a double, b double")
    assert [r["prediction"] for r in model.transform(empty).collect()] == [None]
    assert model.transform(empty.limit(0)).count() == 0
    with pytest.raises(FileNotFoundError):
        load_champion(spark, scratch_dir(spark, "no-champion"))
    with pytest.raises(ValueError):
        GramRegression(["a"], "y", "none such")


def test_learned_ranges(spark):
    from mortar.operators.score import learned_ranges, range_warnings
    train = spark.createDataFrame([(1.0, None, 5.0), (3.0, None, None)], "a double, b double, c double")
    ranges = learned_ranges(train, ["a", "b", "c"])
    assert ranges == {"a": (1.0, 3.0), "c": (5.0, 5.0)}
    rows = spark.createDataFrame([(3.0, 9.0, 5.0), (0.5, 9.0, 6.0), (None, 1.0, None)], "a double, b double, c double")
    found = [r[0] for r in rows.select(range_warnings(ranges)).collect()]
    assert found == [[], ["a=0.5 outside [1.0, 3.0]", "c=6.0 outside [5.0, 5.0]"], []]
    assert learned_ranges(train.limit(0), ["a", "b"]) == {}
    assert rows.select(range_warnings({}).alias("w")).where("size(w) > 0").count() == 0
