"""One registry of models, read by cross-validation, tuning, stacking and the zoo.

A model is a name, a search space and a *predictor*: ``predictor(features, folds, cols, label, feature_set,
params) -> predictions``. ``folds`` is a fold table (``regime, repeat, fold, row_id, split``): a predictor fits on
the rows of split ``train`` of every (regime, repeat, fold) and predicts the rows of every split, whatever
those are called, so the fits of a nested out-of-fold layout, or of a trial, are just more folds. The result has the
columns of the prediction table (``model .. actual, predicted``).

:func:`register_model` adds a user's own model; nothing else needs to know it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortar.operators import expanded as X
from mortar.operators import extra_trees as ET
from mortar.operators import hist_boost as HB
from mortar.operators import neural as NN
from mortar.operators import trees as TR
from mortar.operators.evaluate import ModelSpec, gram_cv_predictions
from mortar.operators.knn import knn_cv_predictions

KEYS = ["regime", "repeat", "fold"]
OUT = ["model", "feature_set", *KEYS, "split", "row_id", "actual", "predicted"]

Predictor = Callable[[DataFrame, DataFrame, list[str], str, str, dict], DataFrame]


@dataclass(frozen=True)
class Model:
    """``space``: tuples (name, kind, low, high) or (name, "cat", choices), as in :mod:`mortar.operators.tune`."""

    name: str
    space: tuple
    predictor: Predictor
    defaults: dict


MODELS: dict[str, Model] = {}


def register_model(name: str, space: list[tuple], predictor: Predictor, defaults: dict | None = None,
                   replace: bool = False) -> Model:
    """Make a model known to :func:`cv`, tuning, stacking and the zoo. A name is taken once unless ``replace``."""
    if name in MODELS and not replace:
        raise ValueError(f"model {name!r} is registered already")
    MODELS[name] = Model(name, tuple(space), predictor, dict(defaults or {}))
    return MODELS[name]


def model(name: str) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name]


def cv(name: str, features: DataFrame, folds: DataFrame, cols: list[str], label: str, feature_set: str = "",
       params: dict | None = None) -> DataFrame:
    """Predictions of a registered model for every fold of ``folds``; unknown parameters raise."""
    m = model(name)
    given = {**m.defaults, **(params or {})}
    names = {s[0] for s in m.space} | set(m.defaults)
    loose = [s[0].split("{")[0] for s in m.space if "{" in s[0]]
    wrong = [p for p in given if p not in names and not any(p.startswith(x) for x in loose)]
    if wrong:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(wrong))}")
    out = m.predictor(features, folds, cols, label, feature_set, given)
    return out.withColumn("model", F.lit(name)).select(*OUT)


def zoo(features: DataFrame, folds: DataFrame, cols: list[str], label: str, feature_set: str, names: list[str],
        params: dict[str, dict] | None = None) -> DataFrame:
    """H26 for any registered models: one prediction table."""
    parts = [cv(n, features, folds, cols, label, feature_set, (params or {}).get(n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ----------------------------------------------------------------------------- the built-in models
def _number(v):
    """Trial values arrive as doubles or texts; whole numbers become int."""
    if isinstance(v, str):
        try:
            v = float(v)
        except ValueError:
            return v == "True" if v in ("True", "False") else v
    return int(v) if isinstance(v, float) and v.is_integer() else v


def clean(params: dict) -> dict:
    return {k: _number(v) for k, v in params.items()}


def _gram(solver: str) -> Predictor:
    def run(features, folds, cols, label, feature_set, params):
        spec = ModelSpec(solver, solver, clean(params))
        return gram_cv_predictions(features, folds, cols, label, [spec], feature_set)
    return run


def _mllib(name: str) -> Predictor:
    def run(features, folds, cols, label, feature_set, params):
        p = clean(params)
        if isinstance(p.get("max_features"), float):
            p["max_features"] = repr(p["max_features"])
        return TR.cv_predictions(features, folds, cols, label, name, feature_set, p, parallelism=8)
    return run


def _ada(features, folds, cols, label, feature_set, params):
    p = clean(params)
    return TR.adaboost_cv(features, folds, cols, label, feature_set, p.get("n_estimators", 50),
                          lr=p.get("learning_rate", 1.0), loss=p.get("loss", "linear"))


def _extra_trees(features, folds, cols, label, feature_set, params):
    return ET.cv_predictions(features, folds, cols, label, feature_set, **clean(params))


def _hist_boost(features, folds, cols, label, feature_set, params):
    return HB.cv_predictions(features, folds, cols, label, feature_set, **clean(params))


def _ridge_poly(features, folds, cols, label, feature_set, params):
    return X.ridge_poly_predictions(features, folds, cols, label, feature_set, **clean(params))


def _gp(features, folds, cols, label, feature_set, params):
    return X.gp_predictions(features, folds, cols, label, feature_set, **clean(params))


def _svr(features, folds, cols, label, feature_set, params):
    return X.svr_predictions(features, folds, cols, label, feature_set, **clean(params))


def _knn(features, folds, cols, label, feature_set, params):
    p = clean(params)
    return knn_cv_predictions(features, folds, cols, label, feature_set, k=p.get("n_neighbors", 5),
                              weights=p.get("weights", "uniform"), p=p.get("p", 2))


def _mlp(features, folds, cols, label, feature_set, params):
    p = clean(params)
    widths = [int(p[f"units_l{i}"]) for i in range(int(p.get("n_layers", 1))) if f"units_l{i}" in p] or [32]
    return NN.mlp_predictions(features, folds, cols, label, hidden=tuple(widths), seeds=(0,), name="MLP", feature_set=feature_set,
                              activation=p.get("activation", "relu"), alpha=p.get("alpha", 1e-4),
                              lr=p.get("learning_rate_init", 1e-2))


def _register_all() -> None:
    from mortar.operators.tune import SPACES
    register_model("Linear Regression", [], _gram("Linear Regression"))
    for name in ("Ridge", "Lasso", "ElasticNet", "BayesianRidge", "PLS"):
        register_model(name, SPACES[name], _gram(name))
    for name in ("Random Forest", "Gradient Boosting", "XGBoost", "LightGBM", "CatBoost"):
        register_model(name, SPACES[name], _mllib(name))
    register_model("AdaBoost", SPACES["AdaBoost"], _ada)
    register_model("ExtraTrees", SPACES["ExtraTrees"], _extra_trees)
    register_model("HistGradientBoosting", SPACES["HistGradientBoosting"], _hist_boost)
    register_model("Ridge+Poly", SPACES["Ridge+Poly"], _ridge_poly)
    register_model("GaussianProcess", SPACES["GaussianProcess"], _gp)
    register_model("SVR_RBF", SPACES["SVR_RBF"], _svr)
    register_model("KNN", SPACES["KNN"], _knn)
    register_model("MLP", SPACES["MLP"], _mlp)


_register_all()
