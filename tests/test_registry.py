"""The model registry, mixed stacks and model-based tuning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mortar.operators import models, stacking, tune
from mortar.operators.evaluate import ModelSpec
from mortar.operators import splits as S

COLS = ["a", "b", "c"]
META = ModelSpec("meta", "Ridge", {"alpha": 1.0})


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 3))
    y = 30 + 4 * x[:, 0] - 2 * x[:, 1] + 3 * np.sin(2 * x[:, 2]) + rng.normal(size=150) * 0.2
    feats = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                                  "row_id long, a double, b double, c double, y double").cache()
    folds = S.fold_table(feats.select("row_id"), "random", 3, 1, 0).cache()
    return feats, folds, S.oof_folds_random(folds, 4, 0).cache(), x, y


def nearest_mean(features, folds, cols, label, feature_set, params):
    """A user's own model: the mean label of the fold's train rows on the same side of a cut of the first feature."""
    rows = folds.join(features.select("row_id", (F.col(cols[0]) > float(params["cut"])).alias("side"),
                                      F.col(label).alias("actual")), "row_id")
    means = rows.where("split = 'train'").groupBy("regime", "repeat", "fold", "side").agg(F.avg("actual").alias("predicted"))
    return rows.join(means, ["regime", "repeat", "fold", "side"]).withColumn("feature_set", F.lit(feature_set))


@pytest.fixture(scope="module")
def own_model():
    models.register_model("Nearest Mean", [("cut", "float", -2.0, 2.0)], nearest_mean, {"cut": 0.0})
    yield "Nearest Mean"
    del models.MODELS["Nearest Mean"]


def test_own_model_in_cv_tuning_stack_and_zoo(spark, study, own_model):
    feats, folds, oof, x, y = study
    pred = models.cv(own_model, feats, folds, COLS, "y", "set")
    assert pred.count() == folds.count()
    log = tune.tune_model(spark, own_model, feats, folds, COLS, "y", 6, startup=3, batch=3, time_limit=120.0).collect()
    assert len(log) == 6 and all(r["state"] == "ok" and -2 <= float(r["params"]["cut"]) <= 2 for r in log)
    out, wide = stacking.mixed_stack(feats, folds, oof, COLS, "y", [(own_model, {}), ("Ridge", {"alpha": 1.0})], META, "S", "set", 4)
    assert out.count() == folds.count() and wide.columns[-2:] == ["p0", "p1"]
    zoo = models.zoo(feats, folds, COLS, "y", "set", [own_model, "Linear Regression"])
    assert {r["model"] for r in zoo.select("model").distinct().collect()} == {own_model, "Linear Regression"}
    with pytest.raises(ValueError):
        models.register_model(own_model, [], nearest_mean)
    with pytest.raises(ValueError):
        models.cv(own_model, feats, folds, COLS, "y", params={"depth": 3})
    with pytest.raises(ValueError):
        models.cv("nothing", feats, folds, COLS, "y")


def ridge(x, y, alpha):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(sd > 0, sd, 1.0)
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda q: y.mean() + ((q - mean) / np.where(sd > 0, sd, 1.0)) @ beta


def test_wide_table_and_meta_by_numpy(spark, study, own_model):
    """Each train row stands once in the wide table, predicted by fits that have not seen it; the meta model agrees."""
    feats, folds, oof, x, y = study
    out, wide = stacking.mixed_stack(feats, folds, oof, COLS, "y", [("Ridge", {"alpha": 2.0}), (own_model, {"cut": 0.3})],
                                     META, "S", "set", 4)
    split = {(r["fold"], r["row_id"]): r["split"] for r in folds.collect()}
    inner = {(r["fold"], r["row_id"]): r["inner_fold"] for r in oof.collect()}
    rows = wide.collect()
    assert len(rows) == len({(r["fold"], r["row_id"]) for r in rows}) == sum(s == "train" for s in split.values())

    def side_mean(xt, yt):
        sides = xt[:, 0] > 0.3
        return lambda q: np.where(q[:, 0] > 0.3, yt[sides].mean(), yt[~sides].mean())

    got = {(r["fold"], r["row_id"]): r["predicted"] for r in out.collect()}
    for f in range(3):
        train = np.array(sorted(i for (g, i), s in split.items() if g == f and s == "train"))
        of = np.array([inner[f, i] for i in train])
        p = np.zeros((len(train), 2))
        for i in np.unique(of):
            a, b = train[of != i], of == i
            p[b, 0] = ridge(x[a], y[a], 2.0)(x[train[b]])
            p[b, 1] = side_mean(x[a], y[a])(x[train[b]])
        mine = {r["row_id"]: (r["p0"], r["p1"]) for r in rows if r["fold"] == f}
        assert np.allclose([mine[i] for i in train], p, atol=1e-8)
        whole = np.column_stack((ridge(x[train], y[train], 2.0)(x), side_mean(x[train], y[train])(x)))
        want = ridge(p, y[train], 1.0)(whole)
        assert np.allclose([got[f, i] for i in range(len(y))], want, atol=1e-7)


def test_stack_leaves_out_a_failing_base(study):
    feats, folds, oof, *_ = study
    bases = [("Ridge", {"alpha": 1.0}), ("Ridge", {"alpha": 5.0}), ("nothing", {})]
    out, wide = stacking.mixed_stack(feats, folds, oof, COLS, "y", bases, META, "S", "set", 4, least_bases=2)
    assert wide.columns[-2:] == ["p0", "p1"]
    with pytest.raises(RuntimeError, match="nothing"):
        stacking.mixed_stack(feats, folds, oof, COLS, "y", bases, META, "S", "set", 4)


def test_tree_and_kernel_bases(spark, study):
    feats, folds, oof, *_ = study
    bases = [("ExtraTrees", {"n_estimators": 5, "max_depth": 5}), ("SVR_RBF", {"C": 10.0, "gamma": 0.1, "epsilon": 0.1}),
             ("KNN", {"n_neighbors": 3, "weights": "distance", "p": 1})]
    out, wide = stacking.mixed_stack(feats, folds, oof, COLS, "y", bases, META, "S", "set", 4)
    assert wide.where("p0 is null or p1 is null or p2 is null").count() == 0
    assert tune.mean_r2(out, "test") > 0.6


SPACE = [("x", "float", 0.0, 1.0), ("y", "logfloat", 1e-3, 1e3), ("kind", "cat", ["a", "b", "c"]), ("n_layers", "int", 1, 3),
         ("units_l{i}", "logint", 8, 128)]


def planted(p):
    layers = int(float(p["n_layers"]))
    assert all((f"units_l{i}" in p) == (i < layers) for i in range(3))
    return (-(float(p["x"]) - 0.7) ** 2 * 4 - (np.log10(float(p["y"])) - 1) ** 2 / 4 - 0.5 * (p["kind"] != "b")
            - 0.2 * (layers != 2) - sum((np.log2(float(p[f"units_l{i}"])) - 5) ** 2 for i in range(layers)) / 40)


def test_proposals_beat_independent_draws():
    """At equal numbers of trials, over several seeds, and inside the space."""
    gains = []
    for seed in range(6):
        history = [(p, planted(p)) for p in tune.propose(SPACE, [], 10, seed)]
        while len(history) < 60:
            history += [(p, planted(p)) for p in tune.propose(SPACE, history, 10, seed)]
        rng = np.random.default_rng(seed)
        draws = []
        for _ in range(60):
            layers = int(rng.integers(1, 4))
            draws.append({"x": rng.random(), "y": 10 ** rng.uniform(-3, 3), "kind": str(rng.choice(["a", "b", "c"])),
                          "n_layers": layers, **{f"units_l{i}": 2 ** rng.uniform(3, 7) for i in range(layers)}})
        assert all(0 <= p["x"] <= 1 and 1e-3 <= p["y"] <= 1e3 and p["kind"] in "abc" for p, _ in history)
        gains.append(max(v for _, v in history) - max(map(planted, draws)))
    assert np.median(gains) > 0 and np.mean(gains) > 0.02


def test_search_logs_failed_and_late_trials(spark):
    import time
    seen = []

    def run(p):
        seen.append(p)
        if len(seen) == 2:
            raise ValueError("no")
        if len(seen) == 3:
            time.sleep(3)
        return -abs(float(p["alpha"]) - 1.0)

    log = tune.search(spark, "Ridge", tune.SPACES["Ridge"], run, 9, startup=4, batch=2, time_limit=1.0).collect()
    assert [r["state"] for r in log][:4] == ["ok", "failed", "timeout", "ok"] and len(log) == 9
    assert log[1]["value"] is None and log[2]["value"] == float("-inf")


def test_all_models_can_be_tuned(spark, study):
    """Every model of the search spaces runs a trial drawn from its own space (trees kept few)."""
    feats, folds, *_ = study
    two = folds.where("fold = 0")
    small = {"n_estimators": 3.0, "iterations": 3.0, "max_iter": 3.0}
    for name in tune.SPACES:
        p = tune.propose(list(models.model(name).space), [], 1, 1)[0]
        p = {k: small.get(k, min(v, 4.0) if k in ("max_depth", "depth", "n_components") else v) for k, v in p.items()}
        if name == "PLS":
            p["n_components"] = 2.0
        value = tune.mean_r2(models.cv(name, feats, two, COLS, "y", "", p), "test")
        assert np.isfinite(value), name
