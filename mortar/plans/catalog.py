"""All registered queries (importing the plan modules registers them)."""

from __future__ import annotations

from mortar.plans import q_board, q_eval, q_knn, q_models, q_pairs, q_prep, q_score, q_sources, q_trees, q_tune  # noqa: F401
from mortar.plans.registry import CHECKS, ORACLES, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    """Honest CV summary of OLS under random 5x5 and group 5-fold (engineered features)."""
    from mortar.operators.evaluate import ModelSpec
    spec = [ModelSpec("Linear Regression", "Linear Regression")]
    rnd = q_eval.gram_cv_summary(spark, sf_dir, spec, "random")
    grp = q_eval.gram_cv_summary(spark, sf_dir, spec, "group")
    return rnd.unionByName(grp)
