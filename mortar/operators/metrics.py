"""Regression metrics as grouped aggregations over the long prediction table.

Prediction table (F4): ``model, feature_set, regime, repeat, fold, split, row_id, actual,
predicted``. Every metric is one ``groupBy``; LMI and R^2 need the group mean of the
target, which a first aggregate supplies (two passes, both map-side combined, so the
shuffle carries one row per group and partition, never the rows themselves).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mortar.session import materialize, row_side

METRICS = ["MAE", "MSE", "RMSE", "R2", "LMI", "EAE", "VAF", "STD"]
SPLITS = ["train", "val", "test"]
MAX_BROADCAST_GROUPS = 50_000
FOLD_KEYS = ["model", "feature_set", "regime", "repeat", "fold", "split"]


def _null() -> Column:
    return F.lit(None).cast("double")


def metrics_by(pred: DataFrame, keys: list[str], use_means: bool = False) -> DataFrame:
    """G1-G8 per ``keys``: n, MAE, MSE, RMSE, R2, LMI, EAE, VAF, STD.

    ``use_means``: the rows carry ``__ybar``, the target mean of their (fold, split)
    group, computed upstream (only valid when ``keys`` are the fold-level keys)."""
    err = F.col("predicted") - F.col("actual")
    if use_means and "__ybar" in pred.columns:
        j = pred  # group means already attached (e.g. from the Gram pass): one pass only
    else:
        pred = pred.drop("__ybar")
        means = materialize(pred.groupBy(*keys).agg(F.avg("actual").alias("__ybar")), by=None)
        # counted first: by its estimates Spark may broadcast the predictions instead
        few = means.count() <= MAX_BROADCAST_GROUPS
        j = pred.join(F.broadcast(means) if few else row_side(means), keys)
    dev = F.col("actual") - F.col("__ybar")
    agg = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("MAE"),
        F.avg(err * err).alias("MSE"),
        F.sum(err * err).alias("__sse"),
        F.sum(dev * dev).alias("__sst"),
        F.sum(F.abs(err)).alias("__sae"),
        F.sum(F.abs(dev)).alias("__sad"),
        F.avg(F.abs(err) / F.greatest(F.abs(F.col("actual")), F.lit(1e-9))).alias("EAE"),
        F.var_pop(err).alias("__var_e"),
        F.var_pop("actual").alias("__var_y"),
        F.stddev_pop(err).alias("STD"),
    )
    r2 = (F.when(F.col("n") < 2, _null())
          .when(F.col("__sst") == 0, F.when(F.col("__sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("__sse") / F.col("__sst")))
    lmi = F.when(F.col("__sad") == 0, _null()).otherwise(F.lit(1.0) - F.col("__sae") / F.col("__sad"))
    vaf = F.when(F.col("__var_y") == 0, _null()).otherwise(
        F.lit(100.0) * (F.lit(1.0) - F.col("__var_e") / F.col("__var_y")))
    return agg.select(*keys, "n", "MAE", "MSE", F.sqrt("MSE").alias("RMSE"), r2.alias("R2"),
                      lmi.alias("LMI"), "EAE", vaf.alias("VAF"), "STD")


def metrics_all(pred: DataFrame) -> DataFrame:
    """All eight metrics per (model, feature_set, regime, repeat, fold, split)."""
    return metrics_by(pred, [k for k in FOLD_KEYS if k in pred.columns], use_means=True)


def metrics_pooled(pred: DataFrame) -> DataFrame:
    """Score once over all out-of-fold rows (LOOCV), per model/regime/split."""
    keys = [k for k in ("model", "feature_set", "regime", "split") if k in pred.columns]
    return metrics_by(pred, keys)


def fold_summary(fold_metrics: DataFrame, keys=("model", "feature_set", "regime")) -> DataFrame:
    """Mean and *population* std over folds of r2/mae/rmse per split + overfit gap."""
    keys = [k for k in keys if k in fold_metrics.columns]
    aggs = []
    for s in SPLITS:
        for m, col in (("r2", "R2"), ("mae", "MAE"), ("rmse", "RMSE")):
            v = F.when(F.col("split") == s, F.col(col))
            aggs += [F.avg(v).alias(f"{s}_{m}_mean"), F.stddev_pop(v).alias(f"{s}_{m}_std")]
    out = fold_metrics.groupBy(*keys).agg(*aggs)
    return out.withColumn("overfit_gap", F.col("train_r2_mean") - F.col("test_r2_mean"))


def report_matrix(fold_metrics: DataFrame, keys=("model", "feature_set", "regime")) -> DataFrame:
    """Mean over folds of 8 metrics x 3 splits (explicit pivot values, stable order)."""
    keys = [k for k in keys if k in fold_metrics.columns]
    aggs = [F.avg(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in SPLITS for m in METRICS]
    return fold_metrics.groupBy(*keys).agg(*aggs)


def representative_fold(fold_metrics: DataFrame, keys=("model", "feature_set", "regime")) -> DataFrame:
    """The fold whose test R^2 is closest to the mean test R^2 (ties: lowest repeat, fold)."""
    keys = [k for k in keys if k in fold_metrics.columns]
    t = fold_metrics.where(F.col("split") == "test").select(*keys, "repeat", "fold", F.col("R2").alias("test_r2"))
    w = Window.partitionBy(*keys)
    t = t.withColumn("mean_test_r2", F.avg("test_r2").over(w))
    t = t.withColumn("__d", F.abs(F.col("test_r2") - F.col("mean_test_r2")))
    # folds per (model, regime) are bounded by the fold layout, so this window is small
    rn = F.row_number().over(w.orderBy("__d", "repeat", "fold"))
    return t.withColumn("__rn", rn).where(F.col("__rn") == 1).drop("__rn", "__d")


def prediction_listing(pred: DataFrame, digits: int = 3) -> DataFrame:
    """Actual / predicted / error per split side by side by position (row order)."""
    from mortar.plans.registry import round_half_up
    from mortar.operators.rank import rank_by_numeric
    keyed = rank_by_numeric(pred.select("split", "row_id", "actual", "predicted"), "row_id",
                            partition_by=["split"], out="pos")
    out = None
    for s in SPLITS:
        part = keyed.where(F.col("split") == s).select(
            "pos",
            round_half_up(F.col("actual"), digits).alias(f"{s}_actual"),
            round_half_up(F.col("predicted"), digits).alias(f"{s}_predicted"),
            round_half_up(F.col("predicted") - F.col("actual"), digits).alias(f"{s}_error"))
        out = part if out is None else out.join(part, "pos", "full_outer")
    return out
