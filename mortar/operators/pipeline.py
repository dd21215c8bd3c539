"""The Gram family as Spark ML stages (A7): fitted in a ``Pipeline``, saved and loaded with it.

A champion of any kind is a ``PipelineModel`` on the shared file system: own linear models next to
Spark's feature stages and tree models. ``load_champion`` brings it back for batch or streaming
scoring.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.operators.evaluate import ModelSpec, full_fit
from mortar.operators.linear import SOLVERS


class _Columns(Params):
    features = Param(Params._dummy(), "features", "feature columns", TypeConverters.toListString)
    label = Param(Params._dummy(), "label", "label column", TypeConverters.toString)
    prediction = Param(Params._dummy(), "prediction", "output column", TypeConverters.toString)


class GramRegression(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a solver of the Gram family on all rows (one pass). Rows with nulls are the caller's to drop."""

    solver = Param(Params._dummy(), "solver", "name of the solver", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "the solver's parameters as JSON", TypeConverters.toString)

    def __init__(self, features: list[str] | None = None, label: str = "label", solver: str = "Ridge",
                 options: dict | None = None, prediction: str = "prediction"):
        super().__init__()
        if solver not in SOLVERS:
            raise ValueError(f"unknown solver {solver!r}")
        self._set(features=features or [], label=label, solver=solver, options=json.dumps(options or {}),
                  prediction=prediction)

    def _fit(self, dataset: DataFrame) -> GramRegressionModel:
        get = self.getOrDefault
        spec = ModelSpec(get("solver"), get("solver"), json.loads(get("options")))
        b0, beta = full_fit(dataset, get("features"), get("label"), spec)
        return GramRegressionModel(get("features"), b0, beta, get("prediction"))


class GramRegressionModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """``intercept + sum coefficients_i * features_i``; null where a feature is null."""

    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)
    coefficients = Param(Params._dummy(), "coefficients", "one for each feature", TypeConverters.toListFloat)

    def __init__(self, features: list[str] | None = None, intercept: float = 0.0, coefficients: list[float] | None = None,
                 prediction: str = "prediction"):
        super().__init__()
        self._set(features=features or [], intercept=intercept, coefficients=coefficients or [], prediction=prediction)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = F.lit(self.getOrDefault("intercept"))
        for name, weight in zip(self.getOrDefault("features"), self.getOrDefault("coefficients"), strict=True):
            out = out + F.lit(weight) * F.col(name)
        return dataset.withColumn(self.getOrDefault("prediction"), out)


def load_champion(spark: SparkSession, path: str) -> PipelineModel:
    """The saved pipeline at ``path``; ``FileNotFoundError`` if there is none."""
    try:
        spark.read.text(f"{path.rstrip('/')}/metadata")
    except AnalysisException as e:
        raise FileNotFoundError(f"no champion at {path}") from e
    return PipelineModel.load(path)
