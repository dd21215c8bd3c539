"""Catalog part 10: Gram models on two features, whose normal equations SQL can solve."""

from __future__ import annotations

from pyspark.ml import Pipeline

from mortar.functions import features as fx
from mortar.functions.hashing import h_sql
from mortar.operators import evaluate as EV
from mortar.operators import marks as MK
from mortar.operators import metrics as M
from mortar.operators import pipeline as PL
from mortar.operators.loo import loo_sampled_metrics
from mortar.plans import sql_blocks as Q
from mortar.plans.q_eval import METRIC_DBL, MKEYS, summary_sql
from mortar.plans.q_prep import GKF_CTES, KF_CTES, recursive
from mortar.plans.q_tune import marked_features
from mortar.plans.registry import query, r6, round_sql, with_ctes
from mortar.session import materialize, scratch_dir
from mortar.sources.tables import TARGET, mix_valid

PAIR = ["total_binder", "curing_temp_c"]
SPECS = [EV.ModelSpec("Linear Regression", "Linear Regression"), EV.ModelSpec("Ridge", "Ridge", {"alpha": 1.0}),
         EV.ModelSpec("PLS(1)", "PLS", {"n_components": 1})]

DATA_SQL = "SELECT row_id, " + ", ".join(f"CAST({Q.DERIVED_SQL.get(c, c)} AS DOUBLE) AS x{i}" for i, c in enumerate(PAIR, 1)) \
    + f", {TARGET} AS y FROM mixv"
SUMS = ("CAST(count(*) AS DOUBLE) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * count(*) AS s11, "
        "var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y, "
        "covar_pop(x2, y) * count(*) AS s2y")


def _betas_sql(keys: str, alpha: float = 1.0) -> str:
    """Coefficients of the three models from CTE ``sums``: OLS, ridge on scaled features, one PLS component."""
    two = lambda a11, a12, a22, c1, c2: (f"({a22} * {c1} - {a12} * {c2}) / ({a11} * {a22} - {a12} * {a12})",
                                         f"({a11} * {c2} - {a12} * {c1}) / ({a11} * {a22} - {a12} * {a12})")
    ols = two("s11", "s12", "s22", "s1y", "s2y")
    z = f"SELECT *, sqrt(s11 / n) AS d1, sqrt(s22 / n) AS d2, n + {alpha!r} AS a FROM sums"
    ridge = two("a", "(s12 / (d1 * d2))", "a", "(s1y / d1)", "(s2y / d2)")
    pls = "((s1y / d1) * (s1y / d1) + (s2y / d2) * (s2y / d2)) / (n * (s1y / d1) * (s1y / d1) + n * (s2y / d2) * (s2y / d2)" \
          " + 2 * (s12 / (d1 * d2)) * (s1y / d1) * (s2y / d2))"
    parts = (("Linear Regression", ols[0], ols[1]), ("Ridge", f"{ridge[0]} / d1", f"{ridge[1]} / d2"),
             ("PLS(1)", f"{pls} * (s1y / d1) / d1", f"{pls} * (s2y / d2) / d2"))
    each = " UNION ALL ".join(f"SELECT '{m}' AS model, *, {b1} AS b1, {b2} AS b2 FROM ({z})" for m, b1, b2 in parts)
    return f"SELECT model, {keys} my - m1 * b1 - m2 * b2 AS b0, b1, b2 FROM ({each})"


def _cv_ctes(folds: str) -> dict:
    return {"d": DATA_SQL,
            "sums": f"SELECT regime, repeat, fold, {SUMS} FROM {folds} JOIN d USING (row_id) WHERE split = 'train' "
                    "GROUP BY regime, repeat, fold",
            "coef": _betas_sql("regime, repeat, fold,"),
            "pred": "SELECT model, 'pair' AS feature_set, regime, repeat, fold, split, row_id, y AS actual, "
                    f"b0 + b1 * x1 + b2 * x2 AS predicted FROM {folds} JOIN d USING (row_id) JOIN coef USING (regime, repeat, fold)"}


def _features(spark, sf):
    base = mix_valid(spark, sf)
    return base, fx.engineer(base, "engineered", TARGET).select("row_id", *PAIR, TARGET)


@query("cv_pair_random", summary_sql({**KF_CTES, **Q.inner_random_sql(), **_cv_ctes("folds"), **Q.metrics_sql("pred", MKEYS)}))
def cv_pair_random(spark, sf):
    """I1 over random 5x5 folds: OLS, ridge and PLS(1) on two features."""
    _, feats = _features(spark, sf)
    marked = materialize(MK.fold_marks(materialize(feats), 5, 5, 0), by=None)
    return r6(M.fold_summary(M.metrics_all(EV.marked_cv_predictions(marked, PAIR, TARGET, SPECS, "pair"))))


@query("cv_pair_group", recursive(summary_sql({**GKF_CTES, **Q.inner_group_sql(), **_cv_ctes("gfolds"),
                                               **Q.metrics_sql("pred", MKEYS)})))
def cv_pair_group(spark, sf):
    """I1 over leakage-group folds, the same models."""
    marked = materialize(MK.group_marks(materialize(marked_features(mix_valid(spark, sf), PAIR), by=None)), by=None)
    return r6(M.fold_summary(M.metrics_all(EV.marked_cv_predictions(marked, PAIR, TARGET, SPECS, "pair", regime="group",
                                                                      copies=True))))


@query("refit_pair", round_sql(with_ctes("SELECT * FROM coef", mixv=Q.MIXV, d=DATA_SQL, sums=f"SELECT {SUMS} FROM d",
                                         coef=_betas_sql("")), ["b0", "b1", "b2"]))
def refit_pair(spark, sf):
    """The three models refitted on all rows, one pass for each."""
    _, feats = _features(spark, sf)
    rows = [(s.name, b0, *beta) for s in SPECS for b0, beta in [EV.full_fit(feats, PAIR, TARGET, s)]]
    return r6(spark.createDataFrame(rows, "model string, b0 double, b1 double, b2 double"))


LOO_SQL = ("SELECT 'Linear Regression' AS model, 'pair' AS feature_set, 'loocv' AS regime, 'test' AS split, y AS actual, "
           "y - (y - b0 - b1 * x1 - b2 * x2) / (1 - 1 / n - ((x1 - m1) * (x1 - m1) * s22 - 2 * (x1 - m1) * (x2 - m2) * s12 "
           "+ (x2 - m2) * (x2 - m2) * s11) / (s11 * s22 - s12 * s12)) AS predicted FROM d, sums, "
           "(SELECT * FROM coef WHERE model = 'Linear Regression') c")


@query("metrics_loo_pair", round_sql(with_ctes(
    "SELECT * FROM met", mixv=Q.MIXV, d=DATA_SQL, sums=f"SELECT {SUMS} FROM d", coef=_betas_sql(""), pred=LOO_SQL,
    **Q.metrics_sql("pred", ["model", "feature_set", "regime", "split"])), METRIC_DBL))
def metrics_loo_pair(spark, sf):
    """E3 + G12: exact leave-one-out of OLS on two features, scored on the pooled vector."""
    _, feats = _features(spark, sf)
    return r6(M.metrics_pooled(EV.loo_ols_predictions(feats, PAIR, TARGET, "pair")))


LOO_VAL = "CAST(greatest(1, round_even((n_rows - 1) * 0.2, 0)) AS BIGINT)"


@query("metrics_loo_sampled", round_sql(with_ctes(
    "SELECT split, n, MSE, RMSE, R2, VAF, STD FROM met", mixv=Q.MIXV, d=DATA_SQL,
    o=f"SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS fold, count(*) OVER () AS n_rows, "
      f"row_number() OVER (ORDER BY {h_sql('0', chr(39) + 'loo' + chr(39), 'row_id')}, row_id) - 1 AS pos FROM d",
    pair=f"SELECT f.fold, o.x1, o.x2, o.y, CASE WHEN o.pos - CASE WHEN o.pos > f.pos THEN 1 ELSE 0 END < {LOO_VAL.replace('n_rows', 'o.n_rows')} "
         "THEN 'val' ELSE 'train' END AS split FROM o JOIN (SELECT fold, pos FROM o WHERE fold % 8 = 0) f ON o.pos <> f.pos",
    sums=f"SELECT fold, {SUMS} FROM pair WHERE split = 'train' GROUP BY fold", coef=_betas_sql("fold,"),
    pred="SELECT split, y AS actual, b0 + b1 * x1 + b2 * x2 AS predicted FROM pair "
         "JOIN (SELECT * FROM coef WHERE model = 'Linear Regression') USING (fold)",
    **Q.metrics_sql("pred", ["split"])), ["MSE", "RMSE", "R2", "VAF", "STD"]))
def metrics_loo_sampled(spark, sf):
    """E8 + G13: pooled train and validation metrics of every eighth leave-one-out fold, by downdates."""
    _, feats = _features(spark, sf)
    return r6(loo_sampled_metrics(feats, PAIR, TARGET, 8))


@query("model_roundtrip", round_sql(with_ctes(
    "SELECT row_id, b0 + b1 * x1 + b2 * x2 AS prediction FROM d, (SELECT * FROM coef WHERE model = 'Ridge')", mixv=Q.MIXV,
    d=DATA_SQL, sums=f"SELECT {SUMS} FROM d", coef=_betas_sql("")), ["prediction"]))
def model_roundtrip(spark, sf):
    """A fitted ridge pipeline, saved to the shared folder, loaded again and applied to every row."""
    _, feats = _features(spark, sf)
    fitted = Pipeline(stages=[PL.GramRegression(features=PAIR, label=TARGET, solver="Ridge", options={"alpha": 1.0})]).fit(feats)
    path = scratch_dir(spark, "champion-pipeline")
    fitted.write().overwrite().save(path)
    return r6(PL.load_champion(spark, path).transform(feats).select("row_id", "prediction"))
