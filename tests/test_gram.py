"""NumPy parity for the Gram family (the driver records these queries rows-only)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mortar.functions import features as fx
from mortar.operators import evaluate as EV
from mortar.operators import linear
from mortar.operators.gram import collect_grams, gram_agg, moments, shift_means
from mortar.sources.tables import TARGET, mix_valid
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    feats = fx.engineer(mix_valid(spark, SF_SMALL), "engineered", TARGET)
    cols = fx.ENGINEERED_12
    pdf = feats.toPandas()
    return feats, cols, pdf[cols].to_numpy(float), pdf[TARGET].to_numpy(float)


def _design(x):
    return np.column_stack([np.ones(len(x)), x])


def test_gram_equals_numpy(spark, data):
    feats, cols, x, y = data
    zc = cols + [TARGET]
    shift = shift_means(feats, zc)
    g = collect_grams(gram_agg(feats, zc, [], shift), [], len(zc))[()]
    z = np.column_stack([np.ones(len(y)), x - shift[:-1], y - shift[-1]])
    ref = z.T @ z
    scale = np.sqrt(np.outer(np.diag(ref), np.diag(ref)))  # entries span ~1e22 (w_b_ratio)
    assert np.allclose(g / scale, ref / scale, rtol=0, atol=1e-10)


def test_ols_predictions_match_lstsq(data):
    _, _, x, y = data
    b0, beta = linear.numpy_reference(x, y, "Linear Regression")
    coef, *_ = np.linalg.lstsq(_design(x), y, rcond=None)
    pred_ref = _design(x) @ coef
    assert np.allclose(b0 + x @ beta, pred_ref, rtol=1e-6, atol=1e-6)


def test_ridge_closed_form(data):
    _, _, x, y = data
    alpha = 3.0
    mu, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1.0
    xs = (x - mu) / sd
    beta_s = np.linalg.solve(xs.T @ xs + alpha * np.eye(x.shape[1]), xs.T @ (y - y.mean()))
    b0, beta = linear.numpy_reference(x, y, "Ridge", alpha=alpha)
    assert np.allclose(beta, beta_s / sd, rtol=1e-7, atol=1e-10)
    assert np.isclose(b0, y.mean() - (mu / sd) @ beta_s)


def test_lasso_kkt(data):
    _, _, x, y = data
    alpha = 0.05
    b0, beta = linear.numpy_reference(x, y, "Lasso", alpha=alpha)
    mu, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1.0
    xs = (x - mu) / sd
    bs = beta * sd
    r = y - y.mean() - xs @ bs
    grad = xs.T @ r / len(y)
    active = np.abs(bs) > 1e-10
    assert np.allclose(grad[active], alpha * np.sign(bs[active]), atol=1e-6)
    assert np.all(np.abs(grad[~active]) <= alpha + 1e-6)


def test_pls_full_rank_equals_ols(data):
    _, _, x, y = data
    b_pls = linear.numpy_reference(x, y, "PLS", n_components=12)
    b_ols = linear.numpy_reference(x, y, "Linear Regression")
    pred_pls = b_pls[0] + x @ b_pls[1]
    pred_ols = b_ols[0] + x @ b_ols[1]
    assert np.allclose(pred_pls, pred_ols, rtol=1e-5, atol=1e-4)


def test_bayes_ridge_between_ols_and_zero(data):
    _, _, x, y = data
    b0, beta = linear.numpy_reference(x, y, "BayesianRidge")
    pred = b0 + x @ beta
    r2 = 1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert 0.5 < r2 <= 1.0


def test_loo_matches_refits(spark, data):
    feats, cols, x, y = data
    pred = EV.loo_ols_predictions(feats, cols, TARGET, "engineered_12").orderBy("row_id").toPandas()
    ids = feats.select("row_id").orderBy("row_id").toPandas()["row_id"].to_numpy()
    order = np.argsort(feats.select("row_id").toPandas()["row_id"].to_numpy())
    xs, ys = x[order], y[order]
    for i in [0, 5, 17, 100]:
        m = np.ones(len(ys), bool)
        m[i] = False
        b0, beta = linear.numpy_reference(xs[m], ys[m], "Linear Regression")
        assert np.isclose(pred.loc[pred.row_id == ids[i], "predicted"].iloc[0], b0 + xs[i] @ beta, rtol=1e-5, atol=1e-5)


def test_cv_train_equals_total_minus_parts(spark, data):
    """The train Gram from ``total - test - val`` equals a direct aggregate over train rows."""
    from mortar.operators import splits as S
    feats, cols, _, _ = data
    folds = S.fold_table(mix_valid(spark, SF_SMALL), "random", 5, 1, 0)
    zc = cols + [TARGET]
    shift = shift_means(feats, zc)
    direct = collect_grams(gram_agg(folds.where(F.col("split") == "train").join(feats, "row_id"), zc,
                                    ["regime", "repeat", "fold"], shift), ["regime", "repeat", "fold"], len(zc))
    rows = EV.fold_coefficients(feats, folds, cols, TARGET, [EV.ModelSpec("ols", "Linear Regression")])
    for model, regime, rep, fold, b0, beta in rows:
        m = moments(direct[(regime, rep, fold)])
        b0d, betad = linear.fit_ols(m)
        sx, sy = shift[:-1], shift[-1]
        assert np.allclose(beta, betad, rtol=1e-6, atol=1e-8)
        assert np.isclose(b0, b0d + sy - sx @ betad, rtol=1e-6, atol=1e-6)


def test_learning_curve_matches_numpy(spark, data):
    feats, cols, _, _ = data
    pdf = feats.toPandas().sort_values("row_id")
    x, y = pdf[cols].to_numpy(float), pdf[TARGET].to_numpy(float)
    got = EV.learning_curve(feats, cols, TARGET).orderBy("train_size").toPandas()
    n, k = len(y), 5
    sizes_f = [n // k + (1 if f < n % k else 0) for f in range(k)]
    starts = np.cumsum([0] + sizes_f[:-1])
    n_max = n - sizes_f[0]
    abs_sizes = sorted(set(int(s * n_max) for s in np.linspace(0.2, 1.0, 8)))
    for i, m in enumerate(abs_sizes):
        te_scores = []
        for f in range(k):
            test = np.arange(starts[f], starts[f] + sizes_f[f])
            train = np.setdiff1d(np.arange(n), test)[:m]
            b0, beta = linear.numpy_reference(x[train], y[train], "Linear Regression")
            p = b0 + x[test] @ beta
            te_scores.append(1 - ((y[test] - p) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
        assert got.train_size[i] == m
        assert np.isclose(got.test_r2_mean[i], np.mean(te_scores), rtol=1e-6, atol=1e-6)


def test_stack_fold_matches_numpy(spark):
    """One outer fold of the Gram stack equals the row-level NumPy stack."""
    from mortar.operators import splits as S
    from mortar.operators import stacking as STK
    from mortar.plans.q_models import META_RIDGE, STACK_BASES
    base = mix_valid(spark, SF_SMALL)
    feats = fx.engineer(base, "engineered", TARGET)
    folds = S.fold_table(base, "random", 5, 1, 0).cache()
    oof = S.oof_folds_random(folds, 5, 0).cache()
    pred = STK.stack_predictions(feats, folds, oof, fx.ENGINEERED_12, TARGET, STACK_BASES, META_RIDGE, "s", "e")
    got = pred.where("fold = 0 AND split = 'test'").select("row_id", "predicted").toPandas().set_index("row_id")
    f0 = folds.where("fold = 0").toPandas()
    io = oof.where("fold = 0").toPandas().set_index("row_id")["inner_fold"]
    fp = feats.toPandas().set_index("row_id")
    tr_ids = f0[f0.split == "train"].row_id.to_numpy()
    te_ids = f0[f0.split == "test"].row_id.to_numpy()
    ref = STK.numpy_stack_fold(fp.loc[tr_ids, fx.ENGINEERED_12].to_numpy(float), fp.loc[tr_ids, TARGET].to_numpy(float),
                               io.loc[tr_ids].to_numpy(), fp.loc[te_ids, fx.ENGINEERED_12].to_numpy(float),
                               STACK_BASES, META_RIDGE)
    assert np.allclose(got.loc[te_ids, "predicted"].to_numpy(), ref, rtol=1e-5, atol=1e-5)


def _lstsq(x, y, alpha=0.0):
    """Independent least squares / ridge on standardised columns (no code shared with the package)."""
    mu, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    z = (x - mu) / sd
    if alpha:
        beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    else:
        beta = np.linalg.lstsq(z, y - y.mean(), rcond=1e-7)[0]
    return y.mean() - (mu / sd) @ beta, beta / sd


def test_group_folds_without_cancellation(spark):
    """A ratio of about 1e11 in one fold's rows must not disturb fits on the others."""
    from mortar.operators import evaluate as EV
    from mortar.operators import splits as S
    base = mix_valid(spark, SF_SMALL)
    feats = fx.engineer(base, "engineered", TARGET).cache()
    from mortar.operators import groups as G
    folds = S.fold_table(base, "group", 5, 1, 0, grouped=G.assign_groups(base))
    cols = fx.ENGINEERED_12
    coefs = {r[3]: r for r in EV.fold_coefficients(feats, folds, cols, TARGET, [EV.ModelSpec("ols", "Linear Regression")])}
    fp = feats.select("row_id", *cols, TARGET).toPandas().set_index("row_id")
    table = folds.toPandas()
    assert len(coefs) == 5
    for fold, row in coefs.items():
        part = table[table.fold == fold]
        tr = fp.loc[part[part.split == "train"].row_id]
        x, y = tr[cols].to_numpy(float), tr[TARGET].to_numpy(float)
        b0, beta = _lstsq(x, y)
        want, got = b0 + x @ beta, row[4] + x @ np.array(row[5])
        r2 = [1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() for p in (want, got)]
        assert abs(r2[0] - r2[1]) < 1e-6, (fold, r2)


def test_merged_moments_equal_direct():
    from mortar.operators.gram import Moments, merge_moments, sse
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 3)) * [1, 1e5, 1e-3] + 7, rng.normal(size=60)

    def direct(x, y):
        dx, dy = x - x.mean(axis=0), y - y.mean()
        return Moments(len(y), x.mean(axis=0), y.mean(), dx.T @ dx, dx.T @ dy, dy @ dy)

    whole = direct(x, y)
    merged = merge_moments([direct(x[:10], y[:10]), direct(x[10:11], y[10:11]), direct(x[11:], y[11:])], 3)
    assert np.allclose(whole.sxx, merged.sxx) and np.allclose(whole.sxy, merged.sxy) and np.isclose(whole.syy, merged.syy)
    beta = rng.normal(size=3) * [1, 1e-5, 1e3]
    assert np.isclose(sse(whole, 0.3, beta), ((y - 0.3 - x @ beta) ** 2).sum())
