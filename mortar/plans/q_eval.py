"""Catalog part 2: statistics (F), metrics/reports (G), Gram estimators and CV."""

from __future__ import annotations

from pyspark.sql import functions as F

from mortar.functions import features as fx
from mortar.operators import evaluate as EV
from mortar.operators import groups as G
from mortar.operators import marks as MK
from mortar.operators import metrics as M
from mortar.operators import splits as S
from mortar.operators import stats as ST
from mortar.plans import sql_blocks as Q
from mortar.plans.fixtures import fixture_predictions
from mortar.plans.q_prep import KF_CTES
from mortar.plans.registry import query, r6, round_sql, with_ctes
from mortar.session import materialize
from mortar.sources.tables import RAW_FEATURES, TARGET, mix_valid

MKEYS = ["model", "feature_set", "regime", "repeat", "fold", "split"]
METRIC_DBL = ["MAE", "MSE", "RMSE", "R2", "LMI", "EAE", "VAF", "STD"]
FIX_CTES = {**KF_CTES, **Q.inner_random_sql(), "pred": Q.FIXTURE_PRED}


def _met_ctes(keys, pred="pred"):
    return {**FIX_CTES, **Q.metrics_sql(pred, keys)}


# ----------------------------------------------------------------------------- G


@query("metrics_all", round_sql(with_ctes("SELECT * FROM met", **_met_ctes(MKEYS)), METRIC_DBL))
def metrics_all(spark, sf):
    return r6(M.metrics_all(fixture_predictions(spark, sf)))


@query("metrics_pooled", round_sql(with_ctes("SELECT * FROM met", **_met_ctes(["model", "feature_set", "regime", "split"])),
                                   METRIC_DBL))
def metrics_pooled(spark, sf):
    return r6(M.metrics_pooled(fixture_predictions(spark, sf)))


def summary_sql(ctes):
    """G10 over the metrics in CTE ``met``."""
    cols = []
    for s in M.SPLITS:
        for m, c in (("r2", "R2"), ("mae", "MAE"), ("rmse", "RMSE")):
            cols.append(f"avg(CASE WHEN split = '{s}' THEN {c} END) AS {s}_{m}_mean")
            cols.append(f"stddev_pop(CASE WHEN split = '{s}' THEN {c} END) AS {s}_{m}_std")
    body = (f"SELECT model, feature_set, regime, {', '.join(cols)}, "
            f"avg(CASE WHEN split = 'train' THEN R2 END) - avg(CASE WHEN split = 'test' THEN R2 END) AS overfit_gap "
            f"FROM met GROUP BY model, feature_set, regime")
    names = [f"{s}_{m}_{x}" for s in M.SPLITS for m in ("r2", "mae", "rmse") for x in ("mean", "std")] + ["overfit_gap"]
    return round_sql(with_ctes(body, **ctes), names)


@query("fold_summary", summary_sql(_met_ctes(MKEYS)))
def fold_summary(spark, sf):
    return r6(M.fold_summary(M.metrics_all(fixture_predictions(spark, sf))))


def _report_sql():
    cols = [f"avg(CASE WHEN split = '{s}' THEN {m} END) AS {s}_{m}" for s in M.SPLITS for m in M.METRICS]
    body = f"SELECT model, feature_set, regime, {', '.join(cols)} FROM met GROUP BY model, feature_set, regime"
    return round_sql(with_ctes(body, **_met_ctes(MKEYS)), [f"{s}_{m}" for s in M.SPLITS for m in M.METRICS])


@query("report_matrix", _report_sql())
def report_matrix(spark, sf):
    return r6(M.report_matrix(M.metrics_all(fixture_predictions(spark, sf))))


REP_SQL = ("SELECT model, feature_set, regime, repeat, fold, test_r2, mean_test_r2 FROM ("
           " SELECT *, row_number() OVER (PARTITION BY model, feature_set, regime ORDER BY abs(test_r2 - mean_test_r2), repeat, fold) AS rn"
           " FROM (SELECT model, feature_set, regime, repeat, fold, R2 AS test_r2,"
           " avg(R2) OVER (PARTITION BY model, feature_set, regime) AS mean_test_r2 FROM met WHERE split = 'test')) WHERE rn = 1")


@query("representative_fold", round_sql(with_ctes(REP_SQL, **_met_ctes(MKEYS)), ["test_r2", "mean_test_r2"]))
def representative_fold(spark, sf):
    return r6(M.representative_fold(M.metrics_all(fixture_predictions(spark, sf))))


def _listing_sql():
    def side(s):
        r = lambda e: f"floor(({e}) * 1000.0 + 0.5) / 1000.0"
        return (f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS pos, {r('actual')} AS {s}_actual, "
                f"{r('predicted')} AS {s}_predicted, {r('predicted - actual')} AS {s}_error FROM pred "
                f"JOIN rep USING (repeat, fold) WHERE split = '{s}'")
    body = ("SELECT * FROM (" + side("train") + ") a FULL OUTER JOIN (" + side("val") + ") b USING (pos) "
            "FULL OUTER JOIN (" + side("test") + ") c USING (pos)")
    return with_ctes(body, **_met_ctes(MKEYS), rep=REP_SQL)


@query("prediction_listing", _listing_sql())
def prediction_listing(spark, sf):
    pred = fixture_predictions(spark, sf)
    rep = M.representative_fold(M.metrics_all(pred)).select("repeat", "fold")
    return M.prediction_listing(pred.join(F.broadcast(rep), ["repeat", "fold"]))  # rep is one row


# ----------------------------------------------------------------------------- F

FEAT_COLS = RAW_FEATURES + [TARGET]


def _unpivot_sql(cols, src="mixv"):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols)


@query("describe", round_sql(with_ctes(
    "SELECT feature, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, "
    "quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, "
    "max(value) AS max FROM lng GROUP BY feature", mixv=Q.MIXV, lng=_unpivot_sql(FEAT_COLS)),
    ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def describe(spark, sf):
    return r6(ST.describe(mix_valid(spark, sf), FEAT_COLS))


@query("dataset_overview", with_ctes(
    "SELECT feature, " + ", ".join(f"floor(({e}) * 10000.0 + 0.5) / 10000.0 AS {n}" for e, n in (
        ("min(value)", "min"), ("max(value)", "max"), ("avg(value)", "mean"), ("stddev_samp(value)", "std_dev")))
    + " FROM lng GROUP BY feature", mixv=Q.MIXV, lng=_unpivot_sql(FEAT_COLS)))
def dataset_overview(spark, sf):
    return ST.dataset_overview(mix_valid(spark, sf), FEAT_COLS)


@query("zero_share", round_sql(with_ctes(
    "SELECT feature, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS zero_share, "
    "avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) >= 0.9 AS mostly_zero FROM lng GROUP BY feature",
    mixv=Q.MIXV, lng=_unpivot_sql(RAW_FEATURES)), ["zero_share"]))
def zero_share(spark, sf):
    return r6(ST.zero_share(mix_valid(spark, sf), RAW_FEATURES))


@query("target_corr", round_sql(with_ctes(
    "SELECT feature, corr(value, y) AS corr FROM lng GROUP BY feature", mixv=Q.MIXV,
    lng=" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, {TARGET} AS y FROM mixv" for c in RAW_FEATURES)),
    ["corr"]))
def target_corr(spark, sf):
    return r6(ST.target_corr(mix_valid(spark, sf), RAW_FEATURES, TARGET))


@query("hist_target", round_sql(with_ctes(
    "SELECT g.bin, r.lo + g.bin * (r.hi - r.lo) / 20.0 AS lo, r.lo + (g.bin + 1) * (r.hi - r.lo) / 20.0 AS hi, "
    "CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM rng r, (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 20)) g "
    "LEFT JOIN cnt c ON c.bin = g.bin",
    mixv=Q.MIXV, rng=f"SELECT min({TARGET}) AS lo, max({TARGET}) AS hi FROM mixv",
    cnt=f"SELECT CAST(least(floor(({TARGET} - r.lo) / ((r.hi - r.lo) / 20.0)), 19) AS INTEGER) AS bin, count(*) AS n "
        f"FROM mixv, rng r GROUP BY 1"), ["lo", "hi"]))
def hist_target(spark, sf):
    return r6(ST.histogram(mix_valid(spark, sf), TARGET, 20))


def _ood_sql():
    cols = fx.ENGINEERED_12
    feats = "SELECT row_id, " + ", ".join(f"{Q.DERIVED_SQL.get(c, c)} AS {c}" for c in cols) + " FROM mixv"
    st = ("SELECT repeat, fold, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
          + " FROM folds JOIN feats USING (row_id) WHERE split = 'train' GROUP BY repeat, fold")
    zs = ", ".join(f"abs(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END)" for c in cols)
    body = (f"SELECT repeat, fold, row_id, greatest({zs}) AS max_abs_z FROM folds JOIN feats USING (row_id) "
            f"JOIN st USING (repeat, fold) WHERE split = 'test'")
    return round_sql(with_ctes(body, **KF_CTES, **Q.inner_random_sql(), feats=feats, st=st), ["max_abs_z"])


@query("ood_zscore", _ood_sql())
def ood_zscore(spark, sf):
    base = mix_valid(spark, sf)
    feats = fx.engineer(base, "engineered")
    folds = S.fold_table(base, "random", 5, 5, 0, data=feats)
    return r6(ST.ood_zscore(feats, folds, fx.ENGINEERED_12))


# ----------------------------------------------------------------------------- H1-H7 / I1 (NumPy-checked in pytest)


def study_frame(spark, sf, mode="engineered"):
    base = mix_valid(spark, sf)
    feats = fx.engineer(base, mode, TARGET)
    cols = [c for c in feats.columns if c not in ("row_id", TARGET)]
    return base, feats, cols


def gram_cv_summary(spark, sf, specs, regime="random", mode="engineered", feature_set="engineered_12"):
    base, feats, cols = study_frame(spark, sf, mode)
    if regime == "random":
        # spread over the cluster first: an id is hashed for every (repeat, fold), in three passes
        marked = materialize(MK.fold_marks(materialize(feats), 5, 5, 0), by=None)
        pred = EV.marked_cv_predictions(marked, cols, TARGET, specs, feature_set)
    else:
        folds = materialize(S.fold_table(base, regime, 5, 5, 0, grouped=materialize(G.assign_groups(base))))
        pred = EV.gram_cv_predictions(feats, folds, cols, TARGET, specs, feature_set)
    return r6(M.fold_summary(M.metrics_all(pred)))


def _model_query(qname, specs, regime="random"):
    @query(qname, check="NP")
    def _q(spark, sf):
        return gram_cv_summary(spark, sf, specs, regime)
    return _q


_model_query("fit_ols", [EV.ModelSpec("Linear Regression", "Linear Regression")])
_model_query("fit_ridge", [EV.ModelSpec(f"Ridge(alpha={a})", "Ridge", {"alpha": a}) for a in (0.001, 1.0, 100.0)])
_model_query("fit_lasso", [EV.ModelSpec(f"Lasso(alpha={a})", "Lasso", {"alpha": a}) for a in (0.001, 0.1, 10.0)])
_model_query("fit_elasticnet", [EV.ModelSpec("ElasticNet(0.5,0.5)", "ElasticNet", {"alpha": 0.5, "l1_ratio": 0.5}),
                                EV.ModelSpec("ElasticNet(0.01,0.9)", "ElasticNet", {"alpha": 0.01, "l1_ratio": 0.9})])
_model_query("fit_bayes_ridge", [EV.ModelSpec("BayesianRidge", "BayesianRidge")])
_model_query("fit_pls", [EV.ModelSpec(f"PLS({k})", "PLS", {"n_components": k}) for k in (1, 2, 4, 8)])
_model_query("cv_random", [EV.ModelSpec("Linear Regression", "Linear Regression"),
                           EV.ModelSpec("Ridge", "Ridge", {"alpha": 1.0})], "random")
_model_query("cv_group", [EV.ModelSpec("Linear Regression", "Linear Regression"),
                          EV.ModelSpec("Ridge", "Ridge", {"alpha": 1.0})], "group")


@query("metrics_loo_ols", check="NP")
def metrics_loo_ols(spark, sf):
    """E3 + G12: exact LOOCV of OLS in one pass, scored once on the pooled vector."""
    base, feats, cols = study_frame(spark, sf)
    return r6(M.metrics_pooled(EV.loo_ols_predictions(feats, cols, TARGET, "engineered_12")))
