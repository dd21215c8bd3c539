"""Gram-family estimators (H1-H7, meta learners): p x p solves on centered moments.

Every solver maps :class:`~mortar.operators.gram.Moments` of a training set to
``(intercept, coef)`` in the shifted coordinates used by the Gram pass; prediction is
``b0 + x . coef`` as a Catalyst expression. "Scaled" variants reproduce a standard
scaler fitted on the training rows (population std; a constant column keeps scale 1).
"""

from __future__ import annotations

import numpy as np

from mortar.operators.gram import Moments

PINV_RTOL = 1e-10


def _scale(m: Moments) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(m.sxx), 0.0) / max(m.n, 1.0))
    sd[sd == 0] = 1.0
    return sd


def _finish(m: Moments, beta: np.ndarray) -> tuple[float, np.ndarray]:
    return float(m.my - m.mx @ beta), beta


def _pinv_solve(a: np.ndarray, b: np.ndarray, rtol: float = PINV_RTOL) -> np.ndarray:
    w, v = np.linalg.eigh((a + a.T) / 2)
    keep = w > rtol * max(w.max(initial=0.0), 0.0)
    if not keep.any():
        return np.zeros_like(b)
    return v[:, keep] @ ((v[:, keep].T @ b) / w[keep])


def fit_ols(m: Moments, **_) -> tuple[float, np.ndarray]:
    """H1: least squares with intercept; minimum-norm solution on collinear features.

    Solved in standardised coordinates so the rank tolerance is scale-free (a ratio
    feature can be 1e11 when its denominator is zero); predictions are unaffected.
    """
    sd = _scale(m)
    return _finish(m, _pinv_solve(m.sxx / np.outer(sd, sd), m.sxy / sd) / sd)


def fit_ridge(m: Moments, alpha: float = 1.0, scaled: bool = True, **_) -> tuple[float, np.ndarray]:
    """H2: ridge on standardised features (alpha on the unnormalised squared loss)."""
    sd = _scale(m) if scaled else np.ones(len(m.mx))
    a = m.sxx / np.outer(sd, sd)
    b = m.sxy / sd
    beta_s = np.linalg.solve(a + alpha * np.eye(len(b)), b)
    return _finish(m, beta_s / sd)


def fit_elasticnet(m: Moments, alpha: float = 1.0, l1_ratio: float = 0.5, scaled: bool = True,
                   max_iter: int = 100000, tol: float = 1e-12, **_) -> tuple[float, np.ndarray]:
    """H3/H4: coordinate descent for (1/2n)||r||^2 + a*l1*|b|_1 + a*(1-l1)/2*|b|^2."""
    sd = _scale(m) if scaled else np.ones(len(m.mx))
    n = max(m.n, 1.0)
    q = m.sxx / np.outer(sd, sd) / n
    c = m.sxy / sd / n
    p = len(c)
    beta = np.zeros(p)
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    diag = np.diag(q)
    for _ in range(max_iter):
        delta = 0.0
        for j in range(p):
            if diag[j] <= 0:
                continue
            rho = c[j] - q[j] @ beta + diag[j] * beta[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (diag[j] + l2)
            delta = max(delta, abs(new - beta[j]))
            beta[j] = new
        if delta < tol * max(1.0, np.abs(beta).max(initial=0.0)):
            break
    return _finish(m, beta / sd)


def fit_lasso(m: Moments, alpha: float = 1.0, **kw) -> tuple[float, np.ndarray]:
    return fit_elasticnet(m, alpha=alpha, l1_ratio=1.0, **kw)


def fit_bayes_ridge(m: Moments, alpha_1: float = 1e-6, alpha_2: float = 1e-6, lambda_1: float = 1e-6,
                    lambda_2: float = 1e-6, n_iter: int = 300, tol: float = 1e-3, scaled: bool = True,
                    **_) -> tuple[float, np.ndarray]:
    """H6: evidence maximisation (MacKay) on the eigen-decomposition of the Gram."""
    sd = _scale(m) if scaled else np.ones(len(m.mx))
    xtx = m.sxx / np.outer(sd, sd)
    xty = m.sxy / sd
    n = m.n
    eig, v = np.linalg.eigh((xtx + xtx.T) / 2)
    eig = np.maximum(eig, 0.0)
    vty = v.T @ xty
    var_y = m.syy / n if n > 0 else 0.0
    alpha_ = 1.0 / (var_y + np.finfo(float).eps)
    lambda_ = 1.0
    coef_old = None
    coef = np.zeros(len(xty))
    for _ in range(n_iter):
        coef = v @ (vty / (eig + lambda_ / alpha_))
        sse = m.syy - 2 * coef @ xty + coef @ xtx @ coef
        gamma = np.sum(alpha_ * eig / (lambda_ + alpha_ * eig))
        lambda_ = (gamma + 2 * lambda_1) / (np.sum(coef ** 2) + 2 * lambda_2)
        alpha_ = (n - gamma + 2 * alpha_1) / (sse + 2 * alpha_2)
        if coef_old is not None and np.sum(np.abs(coef_old - coef)) < tol:
            break
        coef_old = coef
    coef = v @ (vty / (eig + lambda_ / alpha_))
    return _finish(m, coef / sd)


def fit_pls(m: Moments, n_components: int = 2, scaled: bool = True, **_) -> tuple[float, np.ndarray]:
    """H7: PLS1 (NIPALS, one response) from the Gram: deflate X'X and X'y."""
    sd = _scale(m) if scaled else np.ones(len(m.mx))
    s = m.sxx / np.outer(sd, sd)
    xy = m.sxy / sd
    p = len(xy)
    ws, ps, qs = [], [], []
    for _ in range(min(n_components, p)):
        norm = np.linalg.norm(xy)
        if norm <= 1e-14 * max(1.0, np.abs(m.sxy).max(initial=0.0)):
            break
        w = xy / norm
        tt = w @ s @ w
        if tt <= 0:
            break
        pl = s @ w / tt
        q = (w @ xy) / tt
        ws.append(w); ps.append(pl); qs.append(q)
        s = s - tt * np.outer(pl, pl)
        xy = xy - pl * (w @ xy)
    if not ws:
        return _finish(m, np.zeros(p))
    W, P, Q = np.array(ws).T, np.array(ps).T, np.array(qs)
    beta_s = W @ np.linalg.solve(P.T @ W, Q)
    return _finish(m, beta_s / sd)


SOLVERS = {
    "Linear Regression": fit_ols,
    "Ridge": fit_ridge,
    "Lasso": fit_lasso,
    "ElasticNet": fit_elasticnet,
    "BayesianRidge": fit_bayes_ridge,
    "PLS": fit_pls,
}


def numpy_reference(x: np.ndarray, y: np.ndarray, solver: str, **params) -> tuple[float, np.ndarray]:
    """Row-level NumPy twin used by tests: builds the same moments from arrays."""
    from mortar.operators.gram import moments
    z = np.column_stack([np.ones(len(y)), x, y])
    return SOLVERS[solver](moments(z.T @ z), **params)
