"""Catalog part 6: search spaces, Gram-based tuning, trial logs (I5-I9), VIF and protocols."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from mortar.functions import features as fx
from mortar.functions.hashing import h_sql
from mortar.operators import groups as G
from mortar.operators import leaderboard as L
from mortar.operators import marks as MK
from mortar.operators import splits as S
from mortar.operators import tune as TU
from mortar.plans.registry import query, r6, round_sql
from mortar.session import materialize
from mortar.sources.tables import TARGET, mix_valid

SPACE_MODELS = sorted(TU.SPACES)


def _space_sql(model, seed=0):
    parts = []
    nl_u = None
    for spec in TU.SPACES[model]:
        names = [spec[0].format(i=i) for i in range(3)] if "{i}" in spec[0] else [spec[0]]
        for nm in names:
            u = f"(CAST({h_sql(str(seed), repr(model).replace(chr(34), chr(39)), 'trial', repr(nm))} AS DOUBLE) / 4294967296.0)"
            kind = spec[1]
            text = "CAST(NULL AS VARCHAR)"
            if kind == "cat":
                ch = spec[2]
                idx = f"CAST(least(floor({u} * {len(ch)}), {len(ch) - 1}) AS INTEGER)"
                val = f"CAST({idx} AS DOUBLE)"
                text = "[" + ", ".join(f"'{c}'" for c in ch) + f"][{idx} + 1]"
            elif kind == "float":
                val = f"({float(spec[2])!r} + {u} * {float(spec[3] - spec[2])!r})"
            elif kind == "logfloat":
                val = f"exp({math.log(spec[2])!r} + {u} * {math.log(spec[3]) - math.log(spec[2])!r})"
            elif kind == "int":
                val = f"least({float(spec[2])!r} + floor({u} * {float(spec[3] - spec[2] + 1)!r}), {float(spec[3])!r})"
            else:
                val = (f"least(floor(exp({math.log(spec[2])!r} + {u} * {math.log(spec[3] + 1) - math.log(spec[2])!r})), "
                       f"{float(spec[3])!r})")
            where = ""
            if nm == "n_layers":
                nl_u = val
            if "{i}" in spec[0]:
                where = f" WHERE {nm[-1]} < ({nl_u})"
            parts.append(f"SELECT '{model}' AS study, CAST(trial AS INTEGER) AS trial, '{nm}' AS name, "
                         f"CAST({val} AS DOUBLE) AS value, {text} AS text FROM (SELECT p_partkey AS trial FROM part"
                         f"){where}")
    return " UNION ALL ".join(parts)


@query("search_space", round_sql(" UNION ALL ".join(f"SELECT * FROM ({_space_sql(m)})" for m in SPACE_MODELS),
                                 ["value"]))
def search_space(spark, sf):
    """Seeded draws for every space (int/log-int/float/log-float/cat/conditional): the trial
    numbers are the keys of ``part``, so the draws grow with the table."""
    from mortar.sources.tables import table
    ids = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("trial"))
    out = None
    for m in SPACE_MODELS:
        t = TU.trial_table(spark, m, 0, ids=ids)
        out = t if out is None else out.unionByName(t)
    return r6(out)


def _group_grams(base):
    """Moments on the leakage-group folds, which rows carry as columns: the moments are all that the trials need."""
    marked = MK.group_marks(materialize(marked_features(base), by=None))
    return MK.marked_moments(materialize(marked, by=None), [*fx.ENGINEERED_12, TARGET], regime="group")


def marked_features(base, cols=fx.ENGINEERED_12):
    """``row_id, group_id``, the features and the target."""
    return fx.engineer(G.assign_groups(base), "engineered", TARGET, keep=("row_id", "group_id")).select(
        "row_id", "group_id", *cols, TARGET)


def _tune_many(spark, sf, models, regime, n_trials=50, time_limit=30.0):
    """Tune several Gram models on one shared set of fold Grams (one pass over the rows)."""
    base = mix_valid(spark, sf)
    feats = fx.engineer(base, "engineered", TARGET)
    cols = fx.ENGINEERED_12
    if regime == "group":
        grams = _group_grams(base)
        mode = ("val", "train")
    else:
        grams = MK.marked_moments(materialize(MK.fold_marks(materialize(feats), 5, 3, 0), by=None), [*cols, TARGET])
        mode = ("test", "trainval")
    logs = [TU.tune(spark, m, feats, None, cols, TARGET, n, 0, mode[0], mode[1], time_limit, grams=grams)
            for m, n in models]
    return L.union_scores(*logs)


def _tune(spark, sf, model, regime, n_trials=50, time_limit=30.0):
    return _tune_many(spark, sf, [(model, n_trials)], regime, n_trials, time_limit)


@query("tune_group", check="INV")
def tune_group(spark, sf):
    """Ridge/Lasso/ElasticNet tuned on group-fold validation R^2 (guarded folds)."""
    return _tune_many(spark, sf, [("Ridge", 50), ("Lasso", 50), ("ElasticNet", 50)], "group")


@query("tune_random", check="INV")
def tune_random(spark, sf):
    """PLS and BayesianRidge tuned on repeated random-KFold *test* R^2."""
    return _tune_many(spark, sf, [("PLS", 8), ("BayesianRidge", 20)], "random")


@query("tune_proposed", check="INV")
def tune_proposed(spark, sf):
    """I6 with density-ratio proposals: 100 trials of each Gram model on the same fold moments."""
    base = mix_valid(spark, sf)
    feats = fx.engineer(base, "engineered", TARGET)
    grams = _group_grams(base)
    return L.union_scores(*[TU.tune_model(spark, m, feats, None, fx.ENGINEERED_12, TARGET, 100, grams=grams)
                            for m in ("Ridge", "Lasso", "ElasticNet", "PLS")])


def _tune_trees(spark, sf, models, n_trials, time_limit):
    base = mix_valid(spark, sf)
    folds = materialize(S.fold_table(base, "group", grouped=materialize(G.assign_groups(base))))
    feats = fx.engineer(base, "engineered", TARGET)
    return L.union_scores(*[TU.tune_fits(spark, m, feats, folds, fx.ENGINEERED_12, TARGET, n_trials, 0,
                                         time_limit=time_limit) for m in models])


@query("tune_trees", check="INV")
def tune_trees(spark, sf):
    """I6 + I8: forests tuned on group-fold validation R^2, 30 s a trial."""
    return _tune_trees(spark, sf, ["Random Forest", "ExtraTrees"], 2, 30.0)


@query("tune_timeout", check="INV")
def tune_timeout(spark, sf):
    """I8: boosting trials of hundreds of trees under a limit of half a second, whose jobs are cancelled."""
    return _tune_trees(spark, sf, ["Gradient Boosting"], 10, 0.5)


@query("best_trial_tuned", check="INV")
def best_trial_tuned(spark, sf):
    """I9 on a real trial log."""
    return L.best_trial(_tune(spark, sf, "ElasticNet", "group", 30))
