"""Statistics / EDA (F1-F9): long (unpivoted) aggregations, exact quantiles by rank.

Quantiles use the exact two-level rank (:mod:`mortar.operators.rank`) and linear
interpolation between the two bracketing order statistics, so no group is ever gathered
into one task (Spark's exact ``percentile`` aggregate would hold every distinct value of a
feature in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mortar.operators.rank import with_quantile_bucket
from mortar.operators.splits import with_data


def unpivot(df: DataFrame, cols: list[str], id_cols: list[str] | None = None,
            name: str = "feature", value: str = "value") -> DataFrame:
    ids = [c for c in (id_cols or []) if c in df.columns]
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ids, cols, name, value)


def cumulative_counts(distinct: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, __c`` (count) with the ranks ``[__b, __e)`` that the value takes in its key, and ``__n``."""
    b = with_quantile_bucket(distinct, value)
    part = b.groupBy(key, "__bkt").agg(F.sum("__c").alias("__s"))
    up = Window.partitionBy(key).orderBy("__bkt").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(key, "__bkt", F.coalesce(F.sum("__s").over(up), F.lit(0)).alias("__off"),
                       F.sum("__s").over(Window.partitionBy(key)).alias("__n"))
    inner = Window.partitionBy(key, "__bkt").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = b.join(part, [key, "__bkt"]).withColumn("__e", F.col("__off") + F.sum("__c").over(inner))
    return out.withColumn("__b", F.col("__e") - F.col("__c")).drop("__bkt", "__off")


def exact_quantiles(long: DataFrame, probs: list[float], key: str = "feature", value: str = "value") -> DataFrame:
    """Linear-interpolated quantiles (pandas/NumPy default) per ``key`` -> key, q, quantile."""
    vals = long.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__c"))
    ranked = cumulative_counts(vals, key, value)  # distinct values: equal values are one row
    out = None
    for p in probs:
        pos = (F.col("__n") - 1) * F.lit(p)
        lo, hi = F.floor(pos), F.ceil(pos)
        at_lo = (F.col("__b") <= lo) & (lo < F.col("__e"))
        at_hi = (F.col("__b") <= hi) & (hi < F.col("__e"))
        pick = ranked.where(at_lo | at_hi).groupBy(key).agg(
            F.min(F.when(at_lo, F.col(value))).alias("__lo"),
            F.min(F.when(at_hi, F.col(value))).alias("__hi"),
            F.first((F.col("__n") - 1) * F.lit(p) - F.floor((F.col("__n") - 1) * F.lit(p))).alias("__f"))
        q = pick.select(key, F.lit(p).alias("q"),
                        (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias("quantile"))
        out = q if out is None else out.unionByName(q)
    return out


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 %, max per column (transposed describe)."""
    long = unpivot(df, cols)
    base = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    qs = exact_quantiles(long, [0.25, 0.5, 0.75])
    wide = qs.groupBy("feature").agg(
        F.max(F.when(F.col("q") == 0.25, F.col("quantile"))).alias("p25"),
        F.max(F.when(F.col("q") == 0.5, F.col("quantile"))).alias("p50"),
        F.max(F.when(F.col("q") == 0.75, F.col("quantile"))).alias("p75"))
    return base.join(wide, "feature", "left")


def dataset_overview(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    """per column min / max / mean / sample std rounded to 4 dp."""
    long = unpivot(df, cols)
    from mortar.plans.registry import round_half_up
    agg = long.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                      F.avg("value").alias("mean"), F.stddev_samp("value").alias("std_dev"))
    return agg.select("feature", *[round_half_up(F.col(c), digits).alias(c) for c in ("min", "max", "mean", "std_dev")])


def overview_items(df: DataFrame, grouped: DataFrame, target: str, n_features: int) -> DataFrame:
    """F2 item list: rows, valid-target rows, groups, feature count."""
    a = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count(target).alias("n_valid"))
    g = grouped.agg(F.countDistinct("group_id").alias("n_groups"))
    return a.crossJoin(g).withColumn("n_features", F.lit(n_features).cast("long"))  # 1 x 1 rows


def zero_share(df: DataFrame, cols: list[str], threshold: float = 0.9) -> DataFrame:
    """share of exact zeros per feature; flag >= threshold."""
    long = unpivot(df, cols)
    out = long.groupBy("feature").agg(F.avg(F.when(F.col("value") == 0, 1.0).otherwise(0.0)).alias("zero_share"))
    return out.withColumn("mostly_zero", F.col("zero_share") >= threshold)


def target_corr(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Pearson correlation of each feature with the target."""
    long = unpivot(df, cols, id_cols=[target])
    return long.groupBy("feature").agg(F.corr("value", target).alias("corr"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """fixed-width histogram over [min, max]; last bin right-closed; empty bins kept."""
    rng = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    w = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    b = df.where(F.col(col).isNotNull()).crossJoin(rng).select(  # rng is one row
        F.least(F.floor((F.col(col) - F.col("__lo")) / w), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "__lo", "__hi")
    out = grid.join(counts, "bin", "left")
    return out.select("bin",
                      (F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / F.lit(bins)).alias("lo"),
                      (F.col("__lo") + (F.col("bin") + 1) * (F.col("__hi") - F.col("__lo")) / F.lit(bins)).alias("hi"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def ood_zscore(features: DataFrame, folds: DataFrame, cols: list[str]) -> DataFrame:
    """per test row, the largest |z| against its train fold (population std, 0 -> 1)."""
    rows = with_data(folds, features.select("row_id", *cols))
    tr = rows.where(F.col("split") == "train")
    stats = tr.groupBy("repeat", "fold").agg(
        *[F.avg(c).alias(f"__m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols])
    te = rows.where(F.col("split") == "test").join(F.broadcast(stats), ["repeat", "fold"])
    zs = [F.abs((F.col(c) - F.col(f"__m_{c}")) /
                F.when(F.col(f"__s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__s_{c}"))) for c in cols]
    return te.select("repeat", "fold", "row_id", F.greatest(*zs).alias("max_abs_z"))


def vif_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """VIF per feature from one Gram pass: regress each column on the others (pinv,
    intercept); ``R^2 >= 1 - 1e-12`` -> infinite (NULL VIF + ``is_infinite``)."""
    import numpy as np
    from mortar.operators import linear
    from mortar.operators.gram import Moments, collect_grams, gram_agg, moments, shift_means
    shift = shift_means(df, cols)
    g = collect_grams(gram_agg(df, cols, [], shift), [], len(cols))[()]
    n = g[0, 0]
    s = g[0, 1:]
    cov = g[1:, 1:] - np.outer(s, s) / n
    rows = []
    for i, c in enumerate(cols):
        o = [j for j in range(len(cols)) if j != i]
        m = Moments(n=n, mx=np.zeros(len(o)), my=0.0, sxx=cov[np.ix_(o, o)], sxy=cov[o, i], syy=cov[i, i])
        _, beta = linear.fit_ols(m)
        sse = m.syy - 2 * beta @ m.sxy + beta @ m.sxx @ beta
        r2 = 1.0 - sse / m.syy if m.syy > 0 else 1.0
        inf = r2 >= 1 - 1e-12
        rows.append((c, None if inf else float(1.0 / (1.0 - r2)), bool(inf), float(r2)))
    del moments
    out = df.sparkSession.createDataFrame(rows, "feature string, VIF double, is_infinite boolean, R2_other double")
    return out.orderBy(F.col("is_infinite").desc(), F.col("VIF").desc())


def vif_summary(vif: DataFrame) -> DataFrame:
    """F8: number over 10 (inf counts), number infinite, median VIF without the infinite ones."""
    return vif.agg(F.count_if(F.col("is_infinite") | (F.col("VIF") > 10)).alias("n_over_10"),
                   F.count_if(F.col("is_infinite")).alias("n_infinite"),
                   F.median("VIF").alias("median_vif_finite"))
