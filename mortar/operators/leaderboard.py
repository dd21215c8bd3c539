"""Relational leaderboard operators over score tables.

All are DataFrame -> DataFrame. Rankings always carry an explicit tiebreak so results do
not depend on partitioning. Score tables hold one row per (model, feature set, regime),
so per-regime windows are small; no operator collects rows to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Model families used to pick diverse stacking bases.
LINEAR = ["Ridge", "Lasso", "ElasticNet", "Ridge+Poly", "BayesianRidge", "Linear Regression", "PLS"]
KERNEL = ["SVR_RBF", "GaussianProcess"]
TREE_ENS = ["Random Forest", "ExtraTrees", "AdaBoost"]
BOOST = ["XGBoost", "LightGBM", "CatBoost", "Gradient Boosting", "HistGradientBoosting"]
# Models allowed for re-tuning.
RETUNE_ALLOWED = ["Gradient Boosting", "LightGBM", "XGBoost", "CatBoost", "ExtraTrees"]


def union_scores(*tables: DataFrame) -> DataFrame:
    """Union of ragged score tables (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def best_per_model(scores: DataFrame, metric: str = "test_r2_mean", part=("cv", "model")) -> DataFrame:
    """The best row per model (ties: feature_set asc)."""
    w = Window.partitionBy(*part).orderBy(F.col(metric).desc(), F.col("feature_set"))
    return scores.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_k(scores: DataFrame, k: int = 10, metric: str = "test_r2_mean", ascending: bool = False) -> DataFrame:
    """Top-k (TakeOrdered) with a full tiebreak."""
    o = F.col(metric).asc() if ascending else F.col(metric).desc()
    return scores.orderBy(o, "model", "feature_set", "cv").limit(k)


def pivot_feature_sets(scores: DataFrame, cv: str, sets=("raw", "engineered_12")) -> DataFrame:
    """Model x feature_set for one regime (test R^2 and gap), explicit columns."""
    s = scores.where(F.col("cv") == cv)
    aggs = []
    for fs in sets:
        aggs.append(F.max(F.when(F.col("feature_set") == fs, F.col("test_r2_mean"))).alias(f"{fs}_test_r2"))
        aggs.append(F.max(F.when(F.col("feature_set") == fs, F.col("overfit_gap"))).alias(f"{fs}_gap"))
    return s.groupBy("model").agg(*aggs)


def pivot_regimes(scores: DataFrame, regimes: list[str]) -> DataFrame:
    """Model x regime: max test R^2 and min gap (regimes absent for a model stay NULL)."""
    aggs = []
    for r in regimes:
        aggs.append(F.max(F.when(F.col("cv") == r, F.col("test_r2_mean"))).alias(f"{r}_test_r2"))
        aggs.append(F.min(F.when(F.col("cv") == r, F.col("overfit_gap"))).alias(f"{r}_gap"))
    return scores.groupBy("model").agg(*aggs)


def slim(scores: DataFrame, regime: str) -> DataFrame:
    """Project + rename for one regime."""
    return scores.where(F.col("cv") == regime).select(
        "model", "feature_set", F.col("test_r2_mean").alias("test_r2"), F.col("overfit_gap").alias("gap"),
        F.lit(regime).alias("regime"))


def dual_regime(scores: DataFrame, regimes: list[str]) -> DataFrame:
    """Tag and union slim leaderboards per regime."""
    return union_scores(*[slim(scores, r) for r in regimes])


def compare_three(old: DataFrame, rnd: DataFrame, grp: DataFrame) -> DataFrame:
    """Inner equi-join of old / random / group tables on model."""
    return (old.select("model", F.col("test_r2").alias("test_r2_old"))
            .join(rnd.select("model", F.col("test_r2").alias("test_r2_random"), F.col("gap").alias("gap_random")), "model")
            .join(grp.select("model", F.col("test_r2").alias("test_r2_group"), F.col("gap").alias("gap_group")), "model"))


def tuned_delta(untuned: DataFrame, tuned: DataFrame) -> DataFrame:
    """Left join by model and deltas (tuned - untuned)."""
    u = untuned.select("model", F.col("test_r2_mean").alias("test_r2_untuned"), F.col("overfit_gap").alias("gap_untuned"))
    t = tuned.select("model", F.col("test_r2_mean").alias("test_r2_tuned"), F.col("overfit_gap").alias("gap_tuned"))
    j = u.join(t, "model", "left")
    return j.withColumn("delta_test_r2", F.col("test_r2_tuned") - F.col("test_r2_untuned")).withColumn(
        "delta_gap", F.col("gap_tuned") - F.col("gap_untuned"))


def pick_champions(scores: DataFrame, metric: str = "test_r2_mean", limit_abs: float = 10.0) -> DataFrame:
    """Per regime the best row with |R^2| < 10 (ties: model, feature_set)."""
    ok = scores.where(F.abs(F.col(metric)) < limit_abs)
    w = Window.partitionBy("cv").orderBy(F.col(metric).desc(), "model", "feature_set")
    return ok.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def threshold_label(c: Column) -> Column:
    """>= 0.95 / >= 0.90 / below, as labels."""
    return (F.when(c >= 0.95, "crossed_0.95").when(c >= 0.90, "crossed_0.90").otherwise("below_0.90"))


def retune_targets(scores: DataFrame, first: int = 6, take: int = 3) -> DataFrame:
    """Distinct (model, feature_set) among the first 6 rows, allowed models, keep order, first 3."""
    head = top_k(scores, first)  # a top-k report: the limit is the feature
    head = head.withColumn("__pos", F.row_number().over(
        Window.orderBy(F.col("test_r2_mean").desc(), "model", "feature_set", "cv")))  # <= first rows
    ok = head.where(F.col("model").isin(RETUNE_ALLOWED))
    firsts = ok.groupBy("model", "feature_set").agg(F.min("__pos").alias("__pos"))
    w2 = Window.orderBy("__pos")
    return firsts.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= take).drop("__pos")


def improve_or_keep(candidates: DataFrame, baseline: DataFrame, metric: str = "test_r2_mean") -> DataFrame:
    """The best candidate replaces the baseline only if strictly better."""
    best = top_k(candidates, 1, metric).select("model", "feature_set", F.col(metric).alias("cand_score"))
    base = baseline.select(F.col("model").alias("base_model"), F.col("feature_set").alias("base_feature_set"),
                           F.col(metric).alias("base_score"))
    j = base.crossJoin(best)  # one row x one row
    better = F.col("cand_score") > F.col("base_score")
    return j.select(F.when(better, F.col("model")).otherwise(F.col("base_model")).alias("model"),
                    F.when(better, F.col("feature_set")).otherwise(F.col("base_feature_set")).alias("feature_set"),
                    F.greatest("cand_score", "base_score").alias("score"), better.alias("replaced"))


def family(c: Column) -> Column:
    return (F.when(c.isin(LINEAR), "linear").when(c.isin(KERNEL), "kernel").when(c.isin(TREE_ENS), "tree_ens")
            .when(c.isin(BOOST), "boost").when(c == "KNN", "instance").otherwise("other"))


def diverse_picks(leaderboard: DataFrame, order: str = "test_r2_mean", k: int = 4) -> DataFrame:
    """Walk the leaderboard, one model per family (SVR_RBF exempt), no linears, stop at k."""
    lb = leaderboard.where(~F.col("model").isin(LINEAR)).withColumn("family", family(F.col("model")))
    w = Window.partitionBy("family").orderBy(F.col(order).desc(), "model")
    first = lb.withColumn("__fr", F.row_number().over(w)).where((F.col("__fr") == 1) | (F.col("model") == "SVR_RBF"))
    wo = Window.orderBy(F.col(order).desc(), "model")
    return first.withColumn("pick", F.row_number().over(wo)).where(F.col("pick") <= k).select("pick", "model", "family")


def majority_feature_set(picks: DataFrame) -> DataFrame:
    """Most common feature set of the bases (tie: first seen)."""
    c = picks.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n"), F.min("pick").alias("first"))
    return c.orderBy(F.col("n").desc(), "first").limit(1).select("feature_set", "n")


def best_trial(trials: DataFrame) -> DataFrame:
    """Per study the first best ok trial, total seconds and trial count."""
    ok = trials.where((F.col("state") == "ok") & F.col("value").isNotNull())
    w = Window.partitionBy("study").orderBy(F.col("value").desc(), "trial")
    best = ok.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(
        "study", F.col("trial").alias("best_trial"), F.col("value").alias("best_value"))
    tot = trials.groupBy("study").agg(F.count(F.lit(1)).alias("n_trials"), F.sum("seconds").alias("tune_seconds"))
    return tot.join(best, "study", "left")


def param_fallback(stores: DataFrame, models: DataFrame, set_order: list[str]) -> DataFrame:
    """Per model the params of the first (feature set, store) in priority order."""
    pri = F.lit(len(set_order))
    for i, s in reversed(list(enumerate(set_order))):
        pri = F.when(F.col("feature_set") == s, F.lit(i)).otherwise(pri)
    cand = stores.withColumn("__p", pri * 10 + F.col("store"))
    w = Window.partitionBy("model").orderBy("__p")
    best = cand.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__p")
    return models.join(best, "model", "left")


def ranked_summary(scores: DataFrame, study: str, regime_r: str, regime_g: str, k: int = 5) -> DataFrame:
    """Top models of a study by random-regime R^2 with their group R^2 and gap."""
    r = scores.where(F.col("cv") == regime_r).groupBy("model").agg(
        F.max("test_r2_mean").alias("random_test_r2"), F.min("overfit_gap").alias("gap"))
    g = scores.where(F.col("cv") == regime_g).groupBy("model").agg(F.max("test_r2_mean").alias("group_test_r2"))
    j = r.join(g, "model", "left")
    w = Window.orderBy(F.col("random_test_r2").desc(), "model")
    out = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    note = (F.when(F.col("rank") == 1, "best on random folds")
            .when(F.col("group_test_r2") == F.max("group_test_r2").over(Window.partitionBy()), "best on group folds")
            .otherwise(""))
    return out.withColumn("study", F.lit(study)).withColumn("note", note)


def improvement(new: DataFrame, old: DataFrame) -> DataFrame:
    """Improvement vs the original single-split table (delta R^2, gaps)."""
    return new.join(old, "model", "inner").select(
        "model", "test_r2_new", "test_r2_old", (F.col("test_r2_new") - F.col("test_r2_old")).alias("delta_test_r2"),
        "gap_new", "gap_old")


def report_fset_map(models: DataFrame, leaderboard: DataFrame, overrides: DataFrame,
                    default: str = "engineered_12") -> DataFrame:
    """Model -> feature set: override, else leaderboard best, else default."""
    lb = best_per_model(leaderboard, part=("model",)).select("model", F.col("feature_set").alias("__lb"))
    j = models.join(overrides.withColumnRenamed("feature_set", "__ov"), "model", "left").join(lb, "model", "left")
    return j.select("pos", "model", F.coalesce("__ov", "__lb", F.lit(default)).alias("feature_set"))


def report_rows(models: DataFrame, matrix: DataFrame) -> DataFrame:
    """Fixed model order; models without metrics keep a blank (NULL) row."""
    return models.join(matrix, "model", "left").orderBy("pos")
