"""Catalog part 7: stacking, VIF, protocols, ablation, refit, feature pruning, scaling, polynomials."""

from __future__ import annotations

from pyspark.sql import functions as F

from mortar.functions import features as fx
from mortar.operators import evaluate as EV
from mortar.operators import groups as G
from mortar.operators import marks as MK
from mortar.operators import metrics as M
from mortar.operators import splits as S
from mortar.operators import stacking as ST
from mortar.operators import stats as STT
from mortar.plans import sql_blocks as Q
from mortar.plans.q_prep import KF_CTES
from mortar.plans.registry import query, r6, round_sql, with_ctes
from mortar.session import freed_shuffles, materialize, row_side
from mortar.sources.tables import RAW_FEATURES, TARGET, mix_valid

STACK_BASES = [EV.ModelSpec("Ridge", "Ridge", {"alpha": 1.0}), EV.ModelSpec("Lasso", "Lasso", {"alpha": 0.01}),
               EV.ModelSpec("PLS", "PLS", {"n_components": 4}), EV.ModelSpec("BayesianRidge", "BayesianRidge")]
META_RIDGE = EV.ModelSpec("meta", "Ridge", {"alpha": 1.0})
META_ENET = EV.ModelSpec("meta", "ElasticNet", {"alpha": 0.5, "l1_ratio": 0.5})


def _stack(spark, sf, regime, meta, name, repeats=5):
    base = mix_valid(spark, sf)
    feats = fx.engineer(base, "engineered", TARGET)
    if regime == "group":
        grouped = materialize(G.assign_groups(base))
        folds = materialize(S.fold_table(base, "group", grouped=grouped))
        oof = materialize(S.oof_folds_group(folds, grouped, 5, 2))
    else:
        marked = S.random_marks(base, 5, repeats, 0)[1]
        found = marked if marked is None else ST.marked_stack(feats, marked, fx.ENGINEERED_12, TARGET, STACK_BASES, meta, name,
                                                              "engineered_12", 5, repeats)
        if found is not None:
            return found
        plain, folds = S.random_folds(base, 5, repeats, 0, data=feats)  # a cut parts copies of an id: ranks
        oof = S.oof_folds_random(plain, 5, 0, rows=folds)
    return ST.stack_predictions(feats, folds, oof, fx.ENGINEERED_12, TARGET, STACK_BASES, meta, name, "engineered_12")


@query("stack_ridge", check="NP")
def stack_ridge(spark, sf):
    """4 Gram bases, Ridge(1) meta on standardised OOF predictions (random 5x5)."""
    return r6(M.fold_summary(M.metrics_all(_stack(spark, sf, "random", META_RIDGE, "Stacked Ensemble"))))


@query("stack_enet", check="NP")
def stack_enet(spark, sf):
    """Same bases, ElasticNet(0.5, 0.5) meta."""
    return r6(M.fold_summary(M.metrics_all(_stack(spark, sf, "random", META_ENET, "Stack_ENet"))))


@query("cv_stack", check="NP")
def cv_stack(spark, sf):
    """OOF stacking under both regimes, random folds five times (group inner folds = max(2, min(5, #groups)))."""
    a = _stack(spark, sf, "random", META_RIDGE, "Stacked Ensemble")
    b = _stack(spark, sf, "group", META_RIDGE, "Stacked Ensemble")
    return r6(M.fold_summary(M.metrics_all(a).unionByName(M.metrics_all(b))))


@query("vif", check="NP")
def vif(spark, sf):
    """F7 on the 21-column 'both' set (collinear by construction -> infinite VIFs)."""
    feats = fx.engineer(mix_valid(spark, sf), "both")
    cols = [c for c in feats.columns if c != "row_id"]
    return r6(STT.vif_table(feats, cols))


@query("vif_summary", check="NP")
def vif_summary(spark, sf):
    feats = fx.engineer(mix_valid(spark, sf), "engineered")
    return r6(STT.vif_summary(STT.vif_table(feats, fx.ENGINEERED_12)))


@query("protocol_table", check="NP")
def protocol_table(spark, sf):
    """OLS under 5x20 and 10x10 random K-fold and exact LOOCV -> test, std, train, gap."""
    base = mix_valid(spark, sf)
    feats = materialize(fx.engineer(base, "engineered", TARGET))
    cols = fx.ENGINEERED_12
    spec = [EV.ModelSpec("Linear Regression", "Linear Regression")]
    out = []
    for k, r, label in ((5, 20, "5x20"), (10, 10, "10x10")):
        marked = materialize(MK.fold_marks(feats, k, r, 0, frac=None), by=None)
        fm = M.metrics_all(EV.marked_cv_predictions(marked, cols, TARGET, spec, "engineered_12", k, label))
        out.append(fm.groupBy("model", "regime").agg(
            F.avg(F.when(F.col("split") == "test", F.col("R2"))).alias("test_r2"),
            F.stddev_pop(F.when(F.col("split") == "test", F.col("R2"))).alias("test_r2_std"),
            F.avg(F.when(F.col("split") == "train", F.col("R2"))).alias("train_r2")))
    loo = M.metrics_pooled(EV.loo_ols_predictions(feats, cols, TARGET, "engineered_12"))
    b0, beta = EV.full_fit(feats, cols, TARGET, spec[0])
    fit = feats.select(F.col(TARGET).alias("actual"), EV.linear_predict(cols, F.lit(b0), F.array(*[F.lit(b) for b in beta]))
                       .alias("predicted"), F.lit("Linear Regression").alias("model"), F.lit("loocv").alias("regime"),
                       F.lit("train").alias("split"))
    train = M.metrics_by(fit, ["model", "regime"]).select("model", "regime", F.col("R2").alias("train_r2"))
    out.append(loo.select("model", "regime", F.col("R2").alias("test_r2"), F.lit(0.0).alias("test_r2_std")).join(
        train, ["model", "regime"]))
    res = out[0].unionByName(out[1]).unionByName(out[2])
    res = res.withColumn("gap", F.col("train_r2") - F.col("test_r2")).withColumnRenamed("regime", "protocol")
    return r6(res.orderBy(F.col("test_r2").desc()))


@query("ablation_grid", check="NP")
def ablation_grid(spark, sf):
    """Model x feature set x regime grid; the folds of a regime are found once."""
    base = mix_valid(spark, sf)
    both = materialize(fx.engineer(base, "both", TARGET))  # holds the columns of the other sets
    marked = materialize(MK.fold_marks(both, 5, 5, 0), by=None)
    folds = materialize(S.fold_table(base, "group", grouped=materialize(G.assign_groups(base))))
    specs = [EV.ModelSpec("Linear Regression", "Linear Regression"), EV.ModelSpec("Ridge", "Ridge", {"alpha": 1.0})]
    out = None
    for regime in ("random", "group"):
        for mode, fs in (("raw", "raw"), ("engineered", "engineered_12"), ("both", "both")):
            cols = [c for c in fx.engineer(base, mode, TARGET).columns if c not in ("row_id", TARGET)]
            pred = (EV.marked_cv_predictions(marked, cols, TARGET, specs, fs) if regime == "random"
                    else EV.gram_cv_predictions(both, folds, cols, TARGET, specs, fs))
            s = M.fold_summary(M.metrics_all(pred))
            out = s if out is None else out.unionByName(s)
    return r6(out)


@query("refit_champion", check="NP")
def refit_champion(spark, sf):
    """Refit the champion on all rows and score it in-sample (R^2, MAE, RMSE)."""
    feats = fx.engineer(mix_valid(spark, sf), "engineered", TARGET)
    cols = fx.ENGINEERED_12
    spec = EV.ModelSpec("Ridge", "Ridge", {"alpha": 1.0})
    b0, beta = EV.full_fit(feats, cols, TARGET, spec)
    pred = feats.select(F.lit("Ridge").alias("model"), F.lit("full").alias("regime"), F.lit("train").alias("split"),
                        F.col(TARGET).alias("actual"),
                        EV.linear_predict(cols, F.lit(b0), F.array(*[F.lit(b) for b in beta])).alias("predicted"))
    return r6(M.metrics_by(pred, ["model", "regime", "split"]).select("model", "R2", "MAE", "RMSE"))


# ----------------------------------------------------------------------------- C11 / C14 / C15 (SQL)


@query("features_pruned", round_sql(with_ctes(
    "SELECT feature, importance, rk > 3 AS kept FROM (SELECT feature, importance, "
    "row_number() OVER (ORDER BY importance, feature) AS rk FROM ("
    "SELECT feature, abs(corr(value, y)) AS importance FROM lng GROUP BY feature))",
    mixv=Q.MIXV, feats=Q.FEAT_SQL,
    lng=" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {TARGET} AS y FROM feats"
                           for c in fx.ENGINEERED_12)), ["importance"]))
def features_pruned(spark, sf):
    """C11: drop the bottom-3 features by importance (here |corr| with the target) -> engineered_9."""
    feats = fx.engineer(mix_valid(spark, sf), "engineered", TARGET)
    imp = STT.target_corr(feats, fx.ENGINEERED_12, TARGET).select("feature", F.abs("corr").alias("importance"))
    bottom = [r["feature"] for r in imp.orderBy("importance", "feature").limit(3).collect()]  # 3 names
    kept = fx.prune(feats, bottom).columns
    return r6(imp.withColumn("kept", F.col("feature").isin(kept)))


def _std_sql():
    cols = fx.ENGINEERED_12
    feats = "SELECT row_id, " + ", ".join(f"{Q.DERIVED_SQL.get(c, c)} AS {c}" for c in cols) + " FROM mixv"
    lng = " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM feats" for c in cols)
    body = ("SELECT repeat, fold, feature, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 "
            "ELSE stddev_pop(value) END AS scale FROM folds JOIN lng USING (row_id) WHERE split = 'train' "
            "GROUP BY repeat, fold, feature")
    return round_sql(with_ctes(body, **KF_CTES, **Q.inner_random_sql(), feats=feats, lng=lng), ["mean", "scale"])


@query("standardize", _std_sql())
def standardize(spark, sf):
    """C14: scaler fitted on each fold's train rows only (population std, constant -> 1)."""
    base = mix_valid(spark, sf)
    feats = fx.engineer(base, "engineered")
    rows = S.fold_table(base, "random", 5, 5, 0, data=feats).where(F.col("split") == "train")
    cols = fx.ENGINEERED_12
    st = rows.groupBy("repeat", "fold").agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                                            *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    st = st.select("repeat", "fold", F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("__s")) for c in cols])))
    return r6(st.select("repeat", "fold", "feature", "mean",
                        F.when(F.col("__s") == 0, F.lit(1.0)).otherwise(F.col("__s")).alias("scale")))


POLY_IN = ["ggbfs_fraction", "w_b_ratio", "curing_temp_c"]


def _poly_sql():
    terms = fx.poly_terms(POLY_IN, 2, False) + [t for t in fx.poly_terms(POLY_IN, 3, True) if len(t) == 3]
    sel = ", ".join(" * ".join(f"({Q.DERIVED_SQL.get(n, n)})" for n in t) + f" AS {'__'.join(t)}" for t in terms)
    return with_ctes(f"SELECT row_id, {sel} FROM mixv", mixv=Q.MIXV)


@query("poly_features", _poly_sql())
def poly_features(spark, sf):
    """Degree-2 expansion plus the degree-3 interaction term (no bias)."""
    feats = fx.with_derived(mix_valid(spark, sf))
    cols = fx.poly_columns(POLY_IN, 2, False) + [c for c, t in zip(fx.poly_columns(POLY_IN, 3, True),
                                                                     fx.poly_terms(POLY_IN, 3, True)) if len(t) == 3]
    return feats.select("row_id", *cols)


@query("learning_curve", check="NP")
def learning_curve(spark, sf):
    """OLS learning curve, 8 sizes 20-100 %, contiguous 5-fold, one Gram pass."""
    feats = fx.engineer(mix_valid(spark, sf), "engineered", TARGET)
    return r6(EV.learning_curve(feats, fx.ENGINEERED_12, TARGET))


@query("perm_importance", check="INV")
def perm_importance(spark, sf):
    """Ridge permutation importance averaged over group folds, 10 repeats."""
    with freed_shuffles(spark):
        grouped = fx.engineer(G.assign_groups(mix_valid(spark, sf)), "engineered", TARGET, keep=("row_id", "group_id"))
        marked = materialize(MK.group_marks(grouped, 5, 0).drop("group_id"), by=None)
        return r6(EV.marked_importance(marked, fx.ENGINEERED_12, TARGET, EV.ModelSpec("Ridge", "Ridge", {"alpha": 1.0})))


def _group_folds(spark, sf):
    base = mix_valid(spark, sf)
    grouped = materialize(G.assign_groups(base))
    folds = materialize(S.fold_table(base, "group", grouped=grouped))
    return fx.engineer(base, "engineered", TARGET), folds


@query("fit_ridge_poly", check="NP")
def fit_ridge_poly(spark, sf):
    """H5: per-fold scaler -> degree-2 polynomial -> Ridge(1), group folds."""
    from mortar.operators import expanded as X
    feats, folds = _group_folds(spark, sf)
    pred = X.ridge_poly_predictions(feats, folds, fx.ENGINEERED_12, TARGET, "engineered_12", 2, 1.0)
    return r6(M.fold_summary(M.metrics_all(pred)))


@query("fit_gp", check="INV")
def fit_gp(spark, sf):
    """H8: Gaussian process mean via 64 random Fourier features, group folds."""
    from mortar.operators import expanded as X
    feats, folds = _group_folds(spark, sf)
    return r6(M.fold_summary(M.metrics_all(X.gp_predictions(feats, folds, fx.ENGINEERED_12, TARGET, "engineered_12"))))


@query("fit_svr", check="INV")
def fit_svr(spark, sf):
    """H9: RBF SVR via random Fourier features + IRLS on the epsilon-insensitive loss, group folds."""
    from mortar.operators import expanded as X
    feats, folds = _group_folds(spark, sf)
    return r6(M.fold_summary(M.metrics_all(X.svr_predictions(feats, folds, fx.ENGINEERED_12, TARGET, "engineered_12",
                                                             rounds=5))))


def _mlp(spark, sf, seeds, hidden, name):
    from mortar.operators import neural as NN
    feats, folds = _group_folds(spark, sf)
    pred = NN.mlp_predictions(feats, folds, fx.ENGINEERED_12, TARGET, hidden=hidden, seeds=seeds, name=name, feature_set="engineered_12")
    return r6(M.fold_summary(M.metrics_all(pred)))


@query("fit_mlp", check="INV")
def fit_mlp(spark, sf):
    """One hidden layer of 32 ReLU units, Adam, early stopping, group folds."""
    return _mlp(spark, sf, (0,), (32,), "MLP")


@query("seed_ensemble_mlp", check="INV")
def seed_ensemble_mlp(spark, sf):
    """Three MLP seeds trained in the same jobs, predictions averaged."""
    return _mlp(spark, sf, (0, 1, 2), (16,), "MLP_seed_ensemble")


@query("smogn", check="INV")
def smogn(spark, sf):
    """I4: per-fold SMOGN on the train rows (random 5x1 folds): rows per (fold, synthetic)."""
    from mortar.operators import smogn as SM
    base = mix_valid(spark, sf)
    feats = fx.engineer(base, "engineered", TARGET)
    folds = materialize(S.fold_table(base, "random", 5, 1, 0))
    train = folds.where(F.col("split") == "train").join(row_side(feats), "row_id")
    aug = SM.augment(train, fx.ENGINEERED_12, TARGET)
    return aug.groupBy("regime", "repeat", "fold", "synthetic").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(TARGET).alias("mean_target"))


@query("cv_smogn", check="INV")
def cv_smogn(spark, sf):
    """Ridge fitted on SMOGN-augmented train rows; train scored on the real rows only."""
    from mortar.operators import smogn as SM
    base = mix_valid(spark, sf)
    feats = fx.engineer(base, "engineered", TARGET)
    folds = materialize(S.fold_table(base, "random", 5, 1, 0))
    train = folds.where(F.col("split") == "train").join(row_side(feats), "row_id")
    aug = materialize(SM.augment(train, fx.ENGINEERED_12, TARGET))
    return r6(M.fold_summary(M.metrics_all(EV.augmented_cv_predictions(
        feats, folds, aug, fx.ENGINEERED_12, TARGET, [EV.ModelSpec("Ridge", "Ridge", {"alpha": 1.0})], "engineered_12",
        "SMOGN_random"))))


def _vif_pair_sql(a, b):
    feats = f"SELECT {Q.DERIVED_SQL.get(a, a)} AS x1, {Q.DERIVED_SQL.get(b, b)} AS x2 FROM mixv"
    r2 = "corr(x1, x2) * corr(x1, x2)"
    body = " UNION ALL ".join(f"SELECT '{n}' AS feature, 1.0 / (1.0 - {r2}) AS VIF, false AS is_infinite, {r2} AS R2_other "
                              f"FROM pf" for n in (a, b))
    return round_sql(with_ctes(body, mixv=Q.MIXV, pf=feats), ["VIF", "R2_other"])


VIF_PAIR = ("total_binder", "w_b_ratio")


@query("vif_pair", _vif_pair_sql(*VIF_PAIR))
def vif_pair(spark, sf):
    """F7 two-feature case: VIF = 1 / (1 - corr^2), from the same Gram path as `vif`."""
    feats = fx.engineer(mix_valid(spark, sf), "engineered")
    return r6(STT.vif_table(feats, list(VIF_PAIR)))
