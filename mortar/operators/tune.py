"""Hyper-parameter search (I5-I9) as data: seeded trial tables and Gram-based objectives.

* The search space is a table; trial ``t`` draws each parameter from a hash-uniform
  ``u = h(seed, study, t, name) / 2^32`` (int, log-int, float, log-float, categorical,
  conditional ``units_l{i}``), so trials are reproducible and SQL-checkable.
* For the Gram family a trial costs one p x p solve per fold on Grams computed once:
  validation R^2 comes straight from the validation Gram (``SSE = w' G_val w``), so 100
  trials x 5 folds re-read no rows at all.
* A trial runs in a thread with a job group of its own (:func:`limited`): at the limit the
  group's jobs are cancelled and the trial is logged as ``timeout`` with value -inf (I8),
  failures as ``failed`` (I6 skips them when picking the best).
* MLlib models (:func:`tune_fits`) fit every fold per trial and score it by one aggregate.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable

import numpy as np
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mortar.functions.hashing import h
from mortar.operators import linear, trees
from mortar.operators.gram import fold_moments, merge_moments, sse

# Search spaces (name, kind, low, high, choices) per model, as in the study.
SPACES = {
    "Random Forest": [("n_estimators", "int", 100, 800), ("max_depth", "int", 2, 12), ("min_samples_split", "int", 2, 12),
                      ("min_samples_leaf", "int", 1, 8), ("max_features", "float", 0.3, 1.0)],
    "Gradient Boosting": [("n_estimators", "int", 100, 800), ("max_depth", "int", 2, 6),
                          ("learning_rate", "logfloat", 0.01, 0.2), ("min_samples_split", "int", 2, 12),
                          ("min_samples_leaf", "int", 1, 8), ("subsample", "float", 0.6, 1.0)],
    "AdaBoost": [("n_estimators", "int", 50, 400), ("learning_rate", "logfloat", 0.05, 1.5),
                 ("loss", "cat", ["linear", "square", "exponential"])],
    "CatBoost": [("iterations", "int", 200, 1500), ("depth", "int", 2, 8), ("learning_rate", "logfloat", 0.01, 0.2),
                 ("l2_leaf_reg", "logfloat", 1.0, 30.0), ("min_data_in_leaf", "int", 1, 12),
                 ("subsample", "float", 0.6, 1.0), ("rsm", "float", 0.5, 1.0)],
    "LightGBM": [("n_estimators", "int", 200, 1500), ("max_depth", "int", 2, 8), ("learning_rate", "logfloat", 0.01, 0.2),
                 ("num_leaves", "int", 4, 64), ("min_data_in_leaf", "int", 2, 12), ("reg_alpha", "logfloat", 1e-3, 10.0),
                 ("reg_lambda", "logfloat", 1e-3, 10.0), ("subsample", "float", 0.6, 1.0),
                 ("colsample_bytree", "float", 0.5, 1.0)],
    "XGBoost": [("n_estimators", "int", 200, 1500), ("max_depth", "int", 2, 8), ("learning_rate", "logfloat", 0.01, 0.2),
                ("min_child_weight", "int", 1, 10), ("reg_alpha", "logfloat", 1e-3, 10.0),
                ("reg_lambda", "logfloat", 1e-3, 10.0), ("subsample", "float", 0.6, 1.0),
                ("colsample_bytree", "float", 0.5, 1.0), ("gamma", "float", 0.0, 5.0)],
    "Ridge": [("alpha", "logfloat", 1e-3, 100.0)],
    "Lasso": [("alpha", "logfloat", 1e-3, 10.0)],
    "ElasticNet": [("alpha", "logfloat", 1e-3, 10.0), ("l1_ratio", "float", 0.05, 0.95)],
    "Ridge+Poly": [("degree", "int", 2, 3), ("alpha", "logfloat", 1e-2, 100.0), ("interaction_only", "cat", ["False", "True"])],
    "BayesianRidge": [("alpha_1", "logfloat", 1e-7, 1e-3), ("alpha_2", "logfloat", 1e-7, 1e-3),
                      ("lambda_1", "logfloat", 1e-7, 1e-3), ("lambda_2", "logfloat", 1e-7, 1e-3)],
    "GaussianProcess": [("length_scale", "logfloat", 0.1, 20.0), ("noise_level", "logfloat", 1e-3, 5.0),
                        ("alpha", "logfloat", 1e-6, 1e-1)],
    "SVR_RBF": [("C", "logfloat", 0.1, 100.0), ("gamma", "logfloat", 1e-3, 1.0), ("epsilon", "logfloat", 1e-3, 1.0)],
    "KNN": [("n_neighbors", "int", 1, 15), ("weights", "cat", ["uniform", "distance"]), ("p", "cat", ["1", "2"])],
    "ExtraTrees": [("n_estimators", "int", 100, 400), ("max_depth", "int", 2, 14), ("min_samples_split", "int", 2, 12),
                   ("min_samples_leaf", "int", 1, 8), ("max_features", "float", 0.3, 1.0)],
    "HistGradientBoosting": [("max_iter", "int", 100, 400), ("learning_rate", "logfloat", 0.01, 0.2),
                             ("max_depth", "int", 2, 8), ("min_samples_leaf", "int", 5, 25),
                             ("l2_regularization", "logfloat", 1e-4, 10.0), ("max_leaf_nodes", "int", 8, 31)],
    "PLS": [("n_components", "int", 1, 8)],
    "MLP": [("n_layers", "int", 1, 3), ("units_l{i}", "logint", 8, 128), ("activation", "cat", ["relu", "tanh"]),
            ("alpha", "logfloat", 1e-6, 1e-1), ("learning_rate_init", "logfloat", 1e-4, 1e-2),
            ("batch_size", "cat", ["8", "16", "32"])],
}

GRAM_MODELS = {"Ridge": "Ridge", "Lasso": "Lasso", "ElasticNet": "ElasticNet", "BayesianRidge": "BayesianRidge",
               "PLS": "PLS"}


def _draw(spec, u):
    """Map a uniform Column ``u`` to a parameter value Column (double) and a text Column."""
    kind = spec[1]
    if kind == "cat":
        choices = spec[2]
        idx = F.least(F.floor(u * len(choices)), F.lit(len(choices) - 1)).cast("int")
        text = F.element_at(F.array(*[F.lit(c) for c in choices]), idx + 1)
        return idx.cast("double"), text
    lo, hi = spec[2], spec[3]
    if kind == "float":
        v = F.lit(float(lo)) + u * F.lit(float(hi - lo))
    elif kind == "logfloat":
        v = F.exp(F.lit(math.log(lo)) + u * F.lit(math.log(hi) - math.log(lo)))
    elif kind == "int":
        v = F.least(F.lit(float(lo)) + F.floor(u * F.lit(float(hi - lo + 1))), F.lit(float(hi)))
    else:  # logint
        v = F.least(F.floor(F.exp(F.lit(math.log(lo)) + u * F.lit(math.log(hi + 1) - math.log(lo)))), F.lit(float(hi)))
    return v.cast("double"), F.lit(None).cast("string")


def trial_table(spark: SparkSession, model: str, n_trials: int, seed: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """``(study, trial, name, value, text)`` for ``n_trials`` seeded draws of ``model``'s space.

    ``ids``: a table of trial numbers (``trial``) to draw for instead of ``0 .. n_trials - 1``."""
    trials = spark.range(n_trials).select(F.col("id").cast("int").alias("trial")) if ids is None else ids
    parts = []
    space = SPACES[model]
    n_layers = None
    for spec in space:
        name = spec[0]
        if "{i}" in name:
            for i in range(3):
                nm = name.format(i=i)
                u = h(F.lit(seed), F.lit(model), F.col("trial"), F.lit(nm)).cast("double") / F.lit(4294967296.0)
                v, t = _draw(spec, u)
                cond = F.lit(i) < n_layers
                parts.append(trials.select("trial", F.lit(nm).alias("name"), F.when(cond, v).alias("value"),
                                           F.when(cond, t).alias("text")).where(cond))
            continue
        u = h(F.lit(seed), F.lit(model), F.col("trial"), F.lit(name)).cast("double") / F.lit(4294967296.0)
        v, t = _draw(spec, u)
        if name == "n_layers":
            n_layers = v
        parts.append(trials.select("trial", F.lit(name).alias("name"), v.alias("value"), t.alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(model).alias("study"), "trial", "name", "value", "text")


def trial_params(trials: DataFrame) -> dict[int, dict]:
    """Driver view of a (small, n_trials x #params) trial table."""
    out: dict[int, dict] = {}
    for r in trials.collect():
        v = r["text"] if r["text"] is not None else r["value"]
        out.setdefault(r["trial"], {})[r["name"]] = v
    return out


def fold_grams(features: DataFrame, folds: DataFrame, cols: list[str], label: str) -> dict:
    """Moments per (regime, repeat, fold) and split, shared by all trials and models."""
    return fold_moments(features.select("row_id", *cols, label), folds, cols + [label])


def objective(grams: dict, solver: str, params: dict, score_split: str = "val", fit_on: str = "train",
              min_train: int = 5, min_val: int = 2) -> float:
    """Mean R^2 on ``score_split`` over folds; ``fit_on='train'`` excludes val rows,
    ``'trainval'`` fits on everything but test (the random-KFold objective)."""
    scores = []
    for _, parts in sorted(grams.items()):
        empty = merge_moments([], len(parts["train"].mx))
        val = parts.get("val", empty)
        m = parts["train"] if fit_on == "train" else merge_moments([parts["train"], val], len(empty.mx))
        if fit_on == "train" and (m.n < min_train or val.n < min_val):
            continue  # the guard of the group objective
        a, beta = linear.SOLVERS[solver](m, **params)
        ms = val if score_split == "val" else parts.get("test", empty)
        if ms.n < 2:
            continue
        err = sse(ms, a, beta)
        scores.append(1.0 - err / ms.syy if ms.syy > 0 else (1.0 if err == 0 else 0.0))
    return float(np.mean(scores)) if scores else float("nan")


def _solver_params(model: str, p: dict) -> dict:
    out = {}
    for k, v in p.items():
        if k == "n_components":
            out[k] = int(v)
        elif isinstance(v, float):
            out[k] = v
    return out


def tune(spark: SparkSession, model: str, features: DataFrame, folds: DataFrame | None, cols: list[str], label: str,
         n_trials: int = 100, seed: int = 0, score_split: str = "val", fit_on: str = "train",
         time_limit: float = 30.0, grams: dict | None = None) -> DataFrame:
    """Evaluate every trial on shared Grams -> trial log (F8).

    ``grams`` (from :func:`fold_grams`) lets several models share one pass over the rows; ``folds`` is not
    read then."""
    if model not in GRAM_MODELS:
        raise ValueError(f"{model} is not a Gram-family model")
    grams = grams if grams is not None else fold_grams(features, folds, cols, label)
    params = trial_params(trial_table(spark, model, n_trials, seed))
    run = lambda p: objective(grams, GRAM_MODELS[model], _solver_params(model, p), score_split, fit_on)
    return trial_log(spark, model, n_trials, params, run, time_limit)


LOG_SCHEMA = "study string, trial int, params map<string,string>, value double, state string, seconds double"


def limited(spark: SparkSession, name: str, fn: Callable[[], float], limit: float) -> tuple[float | None, str, float]:
    """I8: ``(value, state, seconds)`` of ``fn`` under a time limit that cancels its Spark jobs.

    A fit that starts job after job is cancelled again until its thread has ended."""
    sc, group, box = spark.sparkContext, f"trial-{uuid.uuid4().hex}", {}

    def body():
        sc.setJobGroup(group, name, interruptOnCancel=True)
        try:
            box["value"] = fn()
        except Exception as e:  # noqa: BLE001 - a failed trial is logged, not raised
            box["error"] = e

    t0 = time.perf_counter()
    thread = InheritableThread(target=body, daemon=True)
    thread.start()
    thread.join(limit)
    late = thread.is_alive()
    while thread.is_alive():
        sc.cancelJobGroup(group)
        thread.join(0.1)
    seconds = time.perf_counter() - t0
    if late:
        return float("-inf"), "timeout", seconds
    value = box.get("value")
    return (None, "failed", seconds) if value is None or math.isnan(value) else (value, "ok", seconds)


def trial_log(spark: SparkSession, model: str, n_trials: int, params: dict[int, dict], run: Callable[[dict], float],
              time_limit: float) -> DataFrame:
    """The trial log (F8) of ``run`` over the drawn parameters, each trial under the limit."""
    rows = []
    for t in range(n_trials):
        p = params.get(t, {})
        value, state, seconds = limited(spark, f"{model} trial {t}", lambda: run(p), time_limit)
        rows.append((model, t, {k: str(x) for k, x in p.items()}, value, state, seconds))
    return spark.createDataFrame(rows, LOG_SCHEMA)


def tune_fits(spark: SparkSession, model: str, features: DataFrame, folds: DataFrame, cols: list[str], label: str,
              n_trials: int = 50, seed: int = 0, score_split: str = "val", time_limit: float = 30.0) -> DataFrame:
    """I6-I8 for the MLlib models: a fit per (trial, fold) on the train rows, mean R^2 of ``score_split``."""
    assembled = trees.assemble(features, cols, label)
    keys = [tuple(r) for r in folds.select(*trees.KEYS).distinct().orderBy(*trees.KEYS).collect()]  # fold layout only

    def run(p: dict) -> float:
        scores = []
        for key in keys:
            train, rows = trees.fold_frames(folds, assembled, key)
            held = trees.estimator(model, p).fit(train).transform(rows.where(F.col("split") == score_split))
            r = held.agg(F.sum((F.col("label") - F.col("prediction")) ** 2).alias("sse"), F.var_pop("label").alias("v"),
                         F.count(F.lit(1)).alias("n")).first()
            if r["n"] >= 2:
                scores.append(1.0 - r["sse"] / (r["v"] * r["n"]) if r["v"] > 0 else float(r["sse"] == 0))
        return float(np.mean(scores)) if scores else float("nan")

    return trial_log(spark, model, n_trials, trial_params(trial_table(spark, model, n_trials, seed)), run, time_limit)


# ----------------------------------------------------------------------------- model-based proposals
GOOD_SHARE, CANDIDATES, STARTUP, BATCH = 0.15, 4, 10, 10


def _scaled(spec: tuple, value) -> float:
    """A parameter's value on [0, 1] (choices: their number)."""
    kind, low = spec[1], spec[2]
    if kind == "cat":
        return float(low.index(value) if isinstance(value, str) else int(value))
    high = spec[3]
    if kind.startswith("log"):
        return (math.log(float(value)) - math.log(low)) / (math.log(high) - math.log(low))
    return (float(value) - low) / (high - low)


def _unscaled(spec: tuple, u: float):
    kind, low = spec[1], spec[2]
    if kind == "cat":
        return low[int(u)]
    high = spec[3]
    v = math.exp(math.log(low) + u * (math.log(high) - math.log(low))) if kind.startswith("log") else low + u * (high - low)
    return float(min(high, max(low, round(v)))) if kind.endswith("int") else float(min(high, max(low, v)))


class _Density:
    """Mixture of normals around the points on [0, 1] and a flat part; for choices, smoothed shares."""

    def __init__(self, points: list[float], n_choices: int | None):
        self.n_choices, self.points = n_choices, np.sort(np.array(points, float))
        if n_choices is None:
            gaps = np.diff(np.concatenate(([0.0], self.points, [1.0])))
            least = 1.0 / min(100, 1 + 2 * max(len(points), 1))
            self.widths = np.clip(np.maximum(gaps[:-1], gaps[1:]), least, 1.0)
            inside = [math.erf((1 - p) / w / math.sqrt(2)) + math.erf(p / w / math.sqrt(2))
                      for p, w in zip(self.points, self.widths)]
            self.masses = np.array(inside) / 2
        else:
            counts = np.bincount(self.points.astype(int), minlength=n_choices) + 1.0
            self.shares = counts / counts.sum()

    def draw(self, rng) -> float:
        if self.n_choices is not None:
            return float(rng.choice(self.n_choices, p=self.shares))
        k = rng.integers(len(self.points) + 1)
        if k == len(self.points):
            return float(rng.random())
        while True:  # the bump cut off at the space's ends
            u = rng.normal(self.points[k], self.widths[k])
            if 0.0 <= u <= 1.0:
                return float(u)

    def log(self, u: float) -> float:
        if self.n_choices is not None:
            return math.log(self.shares[int(u)])
        bumps = np.exp(-0.5 * ((u - self.points) / self.widths) ** 2) / self.widths / self.masses / math.sqrt(2 * math.pi)
        return math.log((1.0 + bumps.sum()) / (len(self.points) + 1))


def _specs(space: list[tuple], n_layers: int | None) -> list[tuple]:
    """The parameters of a trial; ``name{i}`` exists for each layer of the trial."""
    return [(spec[0].format(i=i), *spec[1:]) for spec in space
            for i in (range(n_layers or 0) if "{i}" in spec[0] else (0,))]


def propose(space: list[tuple], history: list[tuple[dict, float | None]], n: int, seed: int) -> list[dict]:
    """The next ``n`` trials after ``history`` (parameters, value): the density-ratio rule (Bergstra 2011).

    The best ``GOOD_SHARE`` of the trials gives the density of good values of each parameter, the rest
    (failed and late ones too) that of bad ones; of ``CANDIDATES`` drawn from the good density (few, or the search locks in early) the one with the
    largest ratio is proposed. A conditional parameter's densities come from the trials that have it."""
    done = [(p, -math.inf if v is None else v) for p, v in history]
    order = sorted(range(len(done)), key=lambda k: (-done[k][1], k))
    good = set(order[: max(1, math.ceil(GOOD_SHARE * len(done)))])
    out = []
    for j in range(n):
        rng = np.random.default_rng([seed, len(history), j])
        trial: dict = {}
        for spec in space:
            layers = int(float(trial["n_layers"])) if "n_layers" in trial else 0
            for name, *rest in _specs([spec], layers):
                own = (name, *rest)
                sides = [[_scaled(own, p[name]) for k, (p, _) in enumerate(done) if name in p and (k in good) == side]
                         for side in (True, False)]
                size = len(own[2]) if own[1] == "cat" else None
                yes, no = (_Density(points, size) for points in sides)
                draws = [yes.draw(rng) for _ in range(CANDIDATES)]
                trial[name] = _unscaled(own, max(draws, key=lambda u: yes.log(u) - no.log(u)))
        out.append(trial)
    return out


def search(spark: SparkSession, study: str, space: list[tuple], run: Callable[[dict], float], n_trials: int, seed: int = 0,
           time_limit: float = 30.0, startup: int = STARTUP, batch: int = BATCH) -> DataFrame:
    """The trial log of hash draws (the first ``startup``) and then of proposals, ``batch`` at a time."""
    first = trial_params(trial_table(spark, study, min(startup, n_trials), seed)) if study in SPACES else {}
    trials = [first.get(t, {}) for t in range(min(startup, n_trials))]
    if study not in SPACES:
        trials = propose(space, [], min(startup, n_trials), seed)
    rows: list[tuple] = []
    history: list[tuple[dict, float | None]] = []
    while trials:
        for p in trials:
            value, state, seconds = limited(spark, f"{study} trial {len(rows)}", lambda p=p: run(p), time_limit)
            rows.append((study, len(rows), {k: str(x) for k, x in p.items()}, value, state, seconds))
            history.append((p, value))
        left = n_trials - len(rows)
        trials = propose(space, history, min(batch, left), seed) if left > 0 else []
    return spark.createDataFrame(rows, LOG_SCHEMA)


def mean_r2(predictions: DataFrame, split: str, folds: DataFrame | None = None, min_train: int = 5, min_held: int = 2) -> float:
    """Mean R^2 over the folds of a prediction table; folds below the guard's sizes do not count."""
    per = predictions.groupBy("regime", "repeat", "fold").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == split).alias("n"),
        F.sum(F.when(F.col("split") == split, (F.col("actual") - F.col("predicted")) ** 2)).alias("sse"),
        F.var_pop(F.when(F.col("split") == split, F.col("actual"))).alias("v")).collect()  # one row for each fold
    scores = [1.0 - r["sse"] / (r["v"] * r["n"]) if r["v"] > 0 else float(r["sse"] == 0)
              for r in per if r["n_train"] >= min_train and r["n"] >= min_held]
    return float(np.mean(scores)) if scores else float("nan")


def tune_model(spark: SparkSession, name: str, features: DataFrame, folds: DataFrame, cols: list[str], label: str,
               n_trials: int = 100, seed: int = 0, score_split: str = "val", time_limit: float = 30.0,
               grams: dict | None = None, fit_on: str = "train", startup: int = STARTUP, batch: int = BATCH) -> DataFrame:
    """I6/I7 for any registered model: proposals, each scored by its mean R^2 on ``score_split`` of the folds.

    Gram models are scored on shared ``grams`` if those are given, without a pass over the rows."""
    from mortar.operators import models
    m = models.model(name)
    if name in GRAM_MODELS and grams is not None:
        run = lambda p: objective(grams, GRAM_MODELS[name], _solver_params(name, p), score_split, fit_on)
    else:
        run = lambda p: mean_r2(models.cv(name, features, folds, cols, label, "", p), score_split)
    return search(spark, name, list(m.space), run, n_trials, seed, time_limit, startup, batch)
