"""Catalog part 3: leaderboards (J), tuning bookkeeping (I9-I12) over the F5 score fixture."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mortar.operators import leaderboard as L
from mortar.plans import sql_blocks as Q
from mortar.plans.fixtures import CV_NAMES, SCORE_COLS, score_table
from mortar.plans.registry import query, with_ctes
from mortar.sources.tables import table

SC = Q.score_table_sql()
ALL_COLS = ["model", "feature_set", "cv", *SCORE_COLS, "overfit_gap", "best_optuna_val", "n_trials", "tune_seconds"]


def sc(body: str, **extra) -> str:
    return with_ctes(body, **SC, **extra)


@query("score_table", sc("SELECT * FROM scores"))
def q_score_table(spark, sf):
    return score_table(spark, sf)


@query("union_scores", sc(
    "SELECT * REPLACE (CAST(best_optuna_val AS DOUBLE) AS best_optuna_val, CAST(n_trials AS DOUBLE) AS n_trials, "
    "CAST(tune_seconds AS DOUBLE) AS tune_seconds) FROM ("
    "SELECT * EXCLUDE (best_optuna_val, n_trials, tune_seconds), NULL AS best_optuna_val, NULL AS n_trials, "
    "NULL AS tune_seconds FROM scores WHERE cv = 'random_5x5' UNION ALL SELECT * FROM scores WHERE cv <> 'random_5x5')"))
def union_scores(spark, sf):
    s = score_table(spark, sf)
    a = s.where(F.col("cv") == "random_5x5").drop("best_optuna_val", "n_trials", "tune_seconds")
    return L.union_scores(a, s.where(F.col("cv") != "random_5x5"))


@query("best_per_model", sc(
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cv, model ORDER BY test_r2_mean DESC, feature_set) AS rn "
    "FROM scores) WHERE rn = 1"))
def best_per_model(spark, sf):
    return L.best_per_model(score_table(spark, sf))


@query("leaderboard_topk", sc("SELECT * FROM scores ORDER BY test_r2_mean DESC, model, feature_set, cv LIMIT 10"))
def leaderboard_topk(spark, sf):
    return L.top_k(score_table(spark, sf), 10)


@query("pivot_feature_sets", sc(
    "SELECT model, " + ", ".join(
        f"max(CASE WHEN feature_set = '{fs}' THEN test_r2_mean END) AS {fs}_test_r2, "
        f"max(CASE WHEN feature_set = '{fs}' THEN overfit_gap END) AS {fs}_gap" for fs in ("raw", "engineered_12"))
    + " FROM scores WHERE cv = 'random_5x5' GROUP BY model"))
def pivot_feature_sets(spark, sf):
    return L.pivot_feature_sets(score_table(spark, sf), "random_5x5")


@query("pivot_regimes", sc(
    "SELECT model, " + ", ".join(
        f"max(CASE WHEN cv = '{r}' THEN test_r2_mean END) AS {r}_test_r2, "
        f"min(CASE WHEN cv = '{r}' THEN overfit_gap END) AS {r}_gap" for r in CV_NAMES)
    + " FROM scores GROUP BY model"))
def pivot_regimes(spark, sf):
    return L.pivot_regimes(score_table(spark, sf), CV_NAMES)


SLIM = ("SELECT model, feature_set, test_r2_mean AS test_r2, overfit_gap AS gap, '{r}' AS regime "
        "FROM scores WHERE cv = '{r}'")


@query("dual_regime", sc(" UNION ALL ".join(SLIM.format(r=r) for r in CV_NAMES)))
def dual_regime(spark, sf):
    return L.dual_regime(score_table(spark, sf), CV_NAMES)


def _slim_raw(s, r):
    return L.slim(s.where(F.col("feature_set") == "raw"), r)


@query("compare_old_honest", sc(
    "SELECT o.model, o.test_r2 AS test_r2_old, r.test_r2 AS test_r2_random, r.gap AS gap_random, "
    "g.test_r2 AS test_r2_group, g.gap AS gap_group FROM o JOIN r USING (model) JOIN g USING (model)",
    o=SLIM.format(r="SMOGN_random") + " AND feature_set = 'raw'",
    r=SLIM.format(r="random_5x5") + " AND feature_set = 'raw'",
    g=SLIM.format(r="GroupKFold") + " AND feature_set = 'raw'"))
def compare_old_honest(spark, sf):
    s = score_table(spark, sf)
    return L.compare_three(_slim_raw(s, "SMOGN_random"), _slim_raw(s, "random_5x5"), _slim_raw(s, "GroupKFold"))


@query("tuned_delta", sc(
    "SELECT u.model, u.test_r2_mean AS test_r2_untuned, u.overfit_gap AS gap_untuned, t.test_r2_mean AS test_r2_tuned, "
    "t.overfit_gap AS gap_tuned, t.test_r2_mean - u.test_r2_mean AS delta_test_r2, t.overfit_gap - u.overfit_gap AS delta_gap "
    "FROM u LEFT JOIN t USING (model)",
    u="SELECT * FROM scores WHERE cv = 'random_5x5' AND feature_set = 'raw'",
    t="SELECT * FROM scores WHERE cv = 'random_5x5' AND feature_set = 'engineered_12'"))
def tuned_delta(spark, sf):
    s = score_table(spark, sf).where(F.col("cv") == "random_5x5")
    return L.tuned_delta(s.where(F.col("feature_set") == "raw"), s.where(F.col("feature_set") == "engineered_12"))


PICK_SQL = ("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cv ORDER BY test_r2_mean DESC, model, feature_set) AS rn "
            "FROM scores WHERE abs(test_r2_mean) < 10) WHERE rn = 1")


@query("pick_champions", sc(PICK_SQL))
def pick_champions(spark, sf):
    return L.pick_champions(score_table(spark, sf))


@query("threshold_label", sc(
    "SELECT model, feature_set, cv, test_r2_mean, CASE WHEN test_r2_mean >= 0.95 THEN 'crossed_0.95' "
    "WHEN test_r2_mean >= 0.90 THEN 'crossed_0.90' ELSE 'below_0.90' END AS label FROM scores"))
def threshold_label(spark, sf):
    s = score_table(spark, sf)
    return s.select("model", "feature_set", "cv", "test_r2_mean", L.threshold_label(F.col("test_r2_mean")).alias("label"))


@query("retune_targets", sc(
    "SELECT model, feature_set, row_number() OVER (ORDER BY pos) AS rank FROM ("
    " SELECT model, feature_set, min(pos) AS pos FROM ("
    "  SELECT model, feature_set, row_number() OVER (ORDER BY test_r2_mean DESC, model, feature_set, cv) AS pos FROM scores"
    "  WHERE cv = 'random_5x5' ORDER BY test_r2_mean DESC, model, feature_set, cv LIMIT 6) "
    " WHERE model IN (" + ", ".join(f"'{m}'" for m in L.RETUNE_ALLOWED) + ") GROUP BY model, feature_set) "
    "QUALIFY row_number() OVER (ORDER BY pos) <= 3"))
def retune_targets(spark, sf):
    return L.retune_targets(score_table(spark, sf).where(F.col("cv") == "random_5x5"))


@query("improve_or_keep", sc(
    "SELECT CASE WHEN c.s > b.s THEN c.model ELSE b.model END AS model, "
    "CASE WHEN c.s > b.s THEN c.feature_set ELSE b.feature_set END AS feature_set, greatest(c.s, b.s) AS score, "
    "c.s > b.s AS replaced FROM "
    "(SELECT model, feature_set, test_r2_mean AS s FROM champ WHERE cv = 'GroupKFold') b, "
    "(SELECT model, feature_set, test_r2_mean AS s FROM scores WHERE cv = 'SMOGN_GroupKFold' AND abs(test_r2_mean) < 10 "
    " ORDER BY test_r2_mean DESC, model, feature_set, cv LIMIT 1) c", champ=PICK_SQL))
def improve_or_keep(spark, sf):
    s = score_table(spark, sf)
    base = L.pick_champions(s).where(F.col("cv") == "GroupKFold")
    cand = s.where((F.col("cv") == "SMOGN_GroupKFold") & (F.abs("test_r2_mean") < 10))
    return L.improve_or_keep(cand, base)


@query("ranked_summary", sc(
    "SELECT *, 'CS' AS study, CASE WHEN rank = 1 THEN 'best on random folds' "
    "WHEN group_test_r2 = max(group_test_r2) OVER () THEN 'best on group folds' ELSE '' END AS note FROM ("
    " SELECT *, row_number() OVER (ORDER BY random_test_r2 DESC, model) AS rank FROM ("
    "  SELECT r.model, r.random_test_r2, r.gap, g.group_test_r2 FROM "
    "  (SELECT model, max(test_r2_mean) AS random_test_r2, min(overfit_gap) AS gap FROM scores WHERE cv = 'random_5x5' GROUP BY model) r "
    "  LEFT JOIN (SELECT model, max(test_r2_mean) AS group_test_r2 FROM scores WHERE cv = 'GroupKFold' GROUP BY model) g USING (model))) "
    "WHERE rank <= 5"))
def ranked_summary(spark, sf):
    return L.ranked_summary(score_table(spark, sf), "CS", "random_5x5", "GroupKFold")


@query("improvement", sc(
    "SELECT n.model, n.test_r2_mean AS test_r2_new, o.test_r2_mean AS test_r2_old, n.test_r2_mean - o.test_r2_mean AS delta_test_r2, "
    "n.overfit_gap AS gap_new, o.overfit_gap AS gap_old FROM scores n JOIN scores o USING (model, feature_set) "
    "WHERE n.cv = 'random_5x5' AND o.cv = 'SMOGN_random' AND n.feature_set = 'raw'"))
def improvement(spark, sf):
    s = score_table(spark, sf).where(F.col("feature_set") == "raw")
    new = s.where(F.col("cv") == "random_5x5").select("model", F.col("test_r2_mean").alias("test_r2_new"),
                                                       F.col("overfit_gap").alias("gap_new"))
    old = s.where(F.col("cv") == "SMOGN_random").select("model", F.col("test_r2_mean").alias("test_r2_old"),
                                                         F.col("overfit_gap").alias("gap_old"))
    return L.improvement(new, old)


# The report's model list (display name, registry name, feature-set override).
REPORT_MODELS = [
    ("Linear Regression", "Linear Regression", "raw"), ("Random Forest", "Random Forest", None),
    ("Gradient Boosting", "Gradient Boosting", None), ("AdaBoost", "AdaBoost", None), ("CatBoost", "CatBoost", None),
    ("LightGBM", "LightGBM", None), ("XGBoost", "XGBoost", None), ("SVR (RBF)", "SVR_RBF", None),
    ("ExtraTrees", "ExtraTrees", None), ("HistGradientBoosting", "HistGradientBoosting", None),
    ("Gaussian Process", "GaussianProcess", None), ("Stacked Ensemble", "__STACK__", "engineered_12"),
    ("MLP (ANN)", "MLP", "engineered_9"), ("BoostStack", "__BOOSTSTACK__", "engineered_9"),
    ("GB_seed_ensemble", "__GB_SEED__", "engineered_9"),
]


def _models_df(spark):
    rows = [(i, internal, display) for i, (display, internal, _) in enumerate(REPORT_MODELS)]
    return spark.createDataFrame(rows, "pos int, model string, display string")


def _overrides_df(spark):
    rows = [(internal, ov) for _, internal, ov in REPORT_MODELS if ov]
    return spark.createDataFrame(rows, "model string, feature_set string")


MODELS_SQL = " UNION ALL ".join(f"SELECT {i} AS pos, '{m}' AS model, '{d}' AS display" for i, (d, m, _) in enumerate(REPORT_MODELS))
OVERRIDES_SQL = " UNION ALL ".join(f"SELECT '{m}' AS model, '{o}' AS ov" for _, m, o in REPORT_MODELS if o)


@query("report_fset_map", sc(
    "SELECT m.pos, m.model, coalesce(o.ov, lb.feature_set, 'engineered_12') AS feature_set FROM rm m "
    "LEFT JOIN ovr o USING (model) LEFT JOIN lb USING (model)",
    rm=MODELS_SQL, ovr=OVERRIDES_SQL,
    lb="SELECT model, feature_set FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY test_r2_mean DESC, feature_set) AS rn "
       "FROM scores WHERE cv = 'GroupKFold') WHERE rn = 1"))
def report_fset_map(spark, sf):
    lb = score_table(spark, sf).where(F.col("cv") == "GroupKFold")
    return L.report_fset_map(_models_df(spark).select("pos", "model"), lb, _overrides_df(spark))


@query("report_rows", sc(
    "SELECT m.pos, m.model, m.display, s.test_r2_mean, s.overfit_gap FROM rm m LEFT JOIN "
    "(SELECT model, test_r2_mean, overfit_gap FROM scores WHERE cv = 'random_5x5' AND feature_set = 'engineered_12') s USING (model)",
    rm=MODELS_SQL))
def report_rows(spark, sf):
    s = score_table(spark, sf).where((F.col("cv") == "random_5x5") & (F.col("feature_set") == "engineered_12"))
    return L.report_rows(_models_df(spark), s.select("model", "test_r2_mean", "overfit_gap"))


# ----------------------------------------------------------------------------- I9-I12

def trial_log(spark, sf):
    """F8 fixture: one trial per order; study = priority; failures and time-outs by key."""
    from mortar.plans.registry import round_half_up as r
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    state = F.when(k % 11 == 0, "failed").when(k % 13 == 0, "timeout").otherwise("ok")
    return o.select(F.col("o_orderpriority").alias("study"), k.alias("trial"),
                    F.create_map(F.lit("n_estimators"), (F.col("o_custkey") % 700 + 100).cast("string"),
                                 F.lit("learning_rate"), (F.lit(0.01) + (k % 19) / F.lit(100.0)).cast("string")).alias("params"),
                    F.when(state == "ok", r(F.col("o_totalprice") / F.lit(1e6))).alias("value"),
                    state.alias("state"), ((k % 30).cast("double") + F.lit(0.5)).alias("seconds"))


TRIALS_SQL = ("SELECT o_orderpriority AS study, o_orderkey AS trial, "
              "CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderkey % 13 = 0 THEN 'timeout' ELSE 'ok' END AS state, "
              "CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN "
              "floor(o_totalprice / 1e6 * 1000000.0 + 0.5) / 1000000.0 END AS value, "
              "CAST(o_orderkey % 30 AS DOUBLE) + 0.5 AS seconds FROM orders")


@query("best_trial", with_ctes(
    "SELECT t.study, t.n_trials, t.tune_seconds, b.best_trial, b.best_value FROM "
    "(SELECT study, count(*) AS n_trials, sum(seconds) AS tune_seconds FROM trials GROUP BY study) t LEFT JOIN "
    "(SELECT study, trial AS best_trial, value AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value DESC, trial) AS rn "
    " FROM trials WHERE state = 'ok' AND value IS NOT NULL) WHERE rn = 1) b USING (study)", trials=TRIALS_SQL))
def best_trial(spark, sf):
    return L.best_trial(trial_log(spark, sf))


@query("param_fallback", sc(
    "SELECT m.model, b.feature_set, b.store, b.best_optuna_val FROM (SELECT DISTINCT model FROM scores) m LEFT JOIN ("
    " SELECT * FROM (SELECT model, feature_set, store, best_optuna_val, row_number() OVER (PARTITION BY model ORDER BY "
    " (CASE feature_set WHEN 'engineered_12' THEN 0 WHEN 'engineered_9' THEN 1 WHEN 'raw' THEN 2 ELSE 3 END) * 10 + store) AS rn "
    " FROM stores) WHERE rn = 1) b USING (model)",
    stores="SELECT model, feature_set, CASE WHEN cv = 'random_5x5' THEN 1 ELSE 2 END AS store, best_optuna_val "
           "FROM scores WHERE n_trials IS NOT NULL"))
def param_fallback(spark, sf):
    s = score_table(spark, sf)
    stores = s.where(F.col("n_trials").isNotNull()).select(
        "model", "feature_set", F.when(F.col("cv") == "random_5x5", 1).otherwise(2).alias("store"), "best_optuna_val")
    return L.param_fallback(stores, s.select("model").distinct(), ["engineered_12", "engineered_9", "raw"])


@query("majority_fset", sc(
    "SELECT feature_set, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY test_r2_mean DESC, model) AS pick FROM ("
    " SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY test_r2_mean DESC, feature_set) AS rn "
    " FROM scores WHERE cv = 'GroupKFold') WHERE rn = 1) QUALIFY pick <= 4) GROUP BY feature_set "
    "ORDER BY n DESC, min(pick) LIMIT 1"))
def majority_fset(spark, sf):
    from pyspark.sql import Window
    lb = L.best_per_model(score_table(spark, sf).where(F.col("cv") == "GroupKFold"))
    picks = L.top_k(lb, 4).withColumn("pick", F.row_number().over(Window.orderBy(F.col("test_r2_mean").desc(), "model")))
    return L.majority_feature_set(picks)


@query("diverse_picks", sc(
    "SELECT row_number() OVER (ORDER BY test_r2_mean DESC, model) AS pick, model, family FROM ("
    " SELECT *, row_number() OVER (PARTITION BY family ORDER BY test_r2_mean DESC, model) AS fr FROM ("
    "  SELECT *, CASE WHEN model IN (" + ", ".join(f"'{m}'" for m in L.LINEAR) + ") THEN 'linear' "
    "  WHEN model IN (" + ", ".join(f"'{m}'" for m in L.KERNEL) + ") THEN 'kernel' "
    "  WHEN model IN (" + ", ".join(f"'{m}'" for m in L.TREE_ENS) + ") THEN 'tree_ens' "
    "  WHEN model IN (" + ", ".join(f"'{m}'" for m in L.BOOST) + ") THEN 'boost' WHEN model = 'KNN' THEN 'instance' "
    "  ELSE 'other' END AS family FROM lb WHERE model NOT IN (" + ", ".join(f"'{m}'" for m in L.LINEAR) + ")) "
    ") WHERE fr = 1 OR model = 'SVR_RBF' QUALIFY pick <= 4",
    lb="SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY test_r2_mean DESC, feature_set) AS rn "
       "FROM scores WHERE cv = 'random_5x5') WHERE rn = 1"))
def diverse_picks(spark, sf):
    lb = L.best_per_model(score_table(spark, sf).where(F.col("cv") == "random_5x5"))
    return L.diverse_picks(lb)
