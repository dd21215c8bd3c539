"""SMOGN augmentation of each fold's train rows (I4) and CV with it.

Per (regime, repeat, fold) key, on the train rows only (val/test never change):

1. relevance ``phi(y)`` from box-plot statistics (Tukey hinges, whiskers at 1.5 IQR):
   control points (lower whisker, 1), (median, 0), (upper whisker, 1), a side kept only
   when values lie beyond its whisker; cubic Hermite with zero slopes between points, so
   ``phi >= 0.5`` exactly when y is beyond the midpoint of median and whisker. Rare bins
   are therefore the two tails, the normal bin the middle (closed form, no sort);
2. "balance": every bin targets ``n / #bins`` rows; the normal bin is undersampled by
   hash order (ranked only at the cut), rare bins keep all rows and add synthetic ones;
3. synthetic rows (Branco et al. 2017): each seed case picks one of its k=5 nearest
   neighbours inside its bin (range-normalised Euclidean, exact block kNN keyed by bin);
   closer than half the median neighbour distance -> SMOTER interpolation (one uniform
   draw, target weighted by inverse distances), else Gaussian noise with sd = 0.02 x the
   bin's std per column. Random draws are hash-uniform, so results are reproducible.

Any key whose relevance has no rare or no normal rows is returned unchanged (the study's
fallback to the real rows).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mortar.functions.hashing import h, hash_bucket, order_key
from mortar.operators.rank import assign_by_rank
from mortar.session import materialize, row_side

KEYS = ["regime", "repeat", "fold"]
U32 = 4294967296.0
DISTANCES = 4_000_000  # distances held at once by a task


def _u(*parts):
    return h(*parts).cast("double") / F.lit(U32)


def _hinges(train: DataFrame, label: str) -> DataFrame:
    """Tukey's five-number summary per key via exact order statistics (rank window only on
    the few rows at the picked positions)."""
    from mortar.operators.rank import rank_by_numeric
    r = rank_by_numeric(train.select(*KEYS, F.col(label).alias("__y")), "__y", partition_by=KEYS, out="__r",
                        total_col="__n")
    n = F.col("__n")
    # fivenum: n4 = floor((n+3)/2)/2 ; d = (1, n4, (n+1)/2, n+1-n4, n) (1-based, averaged when .5)
    n4 = F.floor((n + 3) / 2) / 2
    pos = {"lo": n4, "med": (n + 1) / 2, "hi": n + 1 - n4}
    aggs = []
    for name, p in pos.items():
        a, b = F.floor(p) - 1, F.ceil(p) - 1
        aggs.append(((F.min(F.when(F.col("__r") == a, F.col("__y"))) + F.min(F.when(F.col("__r") == b, F.col("__y"))))
                     / 2).alias(name))
    return r.groupBy(*KEYS).agg(*aggs)


def relevance_table(train: DataFrame, label: str, coef: float = 1.5) -> DataFrame:
    """Per key: median, whisker extremes and which tails are relevant (one small row per key)."""
    hg = _hinges(train, label)
    j = train.select(*KEYS, F.col(label).alias("__y")).join(F.broadcast(hg), KEYS)
    iqr = F.col("hi") - F.col("lo")
    stats = j.groupBy(*KEYS, "lo", "med", "hi").agg(
        F.min(F.when(F.col("__y") >= F.col("lo") - coef * iqr, F.col("__y"))).alias("wlo"),
        F.max(F.when(F.col("__y") <= F.col("hi") + coef * iqr, F.col("__y"))).alias("whi"),
        F.min("__y").alias("ymin"), F.max("__y").alias("ymax"), F.count(F.lit(1)).alias("n"))
    return stats.select(*KEYS, "med", "wlo", "whi", "n",
                        (F.col("ymin") < F.col("wlo")).alias("has_low"), (F.col("ymax") > F.col("whi")).alias("has_high"))


def bin_rows(train: DataFrame, rel: DataFrame, label: str) -> DataFrame:
    """Attach the bin (low / normal / high) of every train row."""
    y = F.col(label)
    low = F.col("has_low") & (y <= (F.col("med") + F.col("wlo")) / 2)
    high = F.col("has_high") & (y >= (F.col("med") + F.col("whi")) / 2)
    return train.join(F.broadcast(rel), KEYS).withColumn(
        "bin", F.when(low, "low").when(high, "high").otherwise("normal"))


def _knn_in_bins(rows: DataFrame, zcols: list[str], k: int, block: int = 20000) -> DataFrame:
    """k nearest neighbours (excluding self) within each (key, bin): block nested loop."""
    nb = rows.groupBy(*KEYS, "bin").count().agg(F.max("count")).first()[0] or 1
    P = max(1, math.ceil(nb / block))
    t = rows.select(*KEYS, "bin", F.col("row_id").alias("t_id"), *zcols).withColumn(
        "tb", F.pmod(F.xxhash64("t_id"), F.lit(P)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(P - 1))))
    q = rows.select(*KEYS, "bin", F.col("row_id").alias("q_id"), *zcols).withColumn(
        "qb", F.pmod(F.xxhash64("q_id"), F.lit(P)).cast("int")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(P - 1))))

    def blockfn(tp: pd.DataFrame, qp: pd.DataFrame) -> pd.DataFrame:
        if tp.empty or qp.empty:
            return pd.DataFrame({"regime": [], "repeat": [], "fold": [], "q_id": [], "t_id": [], "d": []})
        xt, xq = tp[zcols].to_numpy(float), qp[zcols].to_numpy(float)
        tid, qid = tp["t_id"].to_numpy(), qp["q_id"].to_numpy()
        kk = min(k, len(tid))
        out_q, out_t, out_d = [], [], []
        step = max(1, DISTANCES // len(xt))
        for a in range(0, len(xq), step):  # some queries at a time
            part, own = xq[a: a + step], qid[a: a + step]
            d = np.zeros((len(part), len(xt)))
            for j in range(len(zcols)):
                diff = part[:, j:j + 1] - xt[None, :, j]
                d = d + diff * diff
            d = np.sqrt(d)
            d[own[:, None] == tid[None, :]] = np.inf
            kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
            rows, cols_ = np.nonzero(d <= kth[:, None])  # k best per query plus ties at the k-th distance
            order = np.lexsort((tid[cols_], d[rows, cols_], rows))
            rows, cols_ = rows[order], cols_[order]
            starts = np.searchsorted(rows, np.arange(len(part)))
            keep = ((np.arange(len(rows)) - starts[rows]) < kk) & np.isfinite(d[rows, cols_])
            rows, cols_ = rows[keep], cols_[keep]
            out_q.append(own[rows])
            out_t.append(tid[cols_])
            out_d.append(d[rows, cols_])
        q_ids = np.concatenate(out_q)
        return pd.DataFrame({"regime": qp["regime"].iloc[0], "repeat": qp["repeat"].iloc[0], "fold": qp["fold"].iloc[0],
                             "q_id": q_ids, "t_id": np.concatenate(out_t), "d": np.concatenate(out_d)})

    keys = [*KEYS, "bin", "tb", "qb"]
    cand = t.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(
        blockfn, "regime string, repeat int, fold int, q_id long, t_id long, d double")
    w = Window.partitionBy(*KEYS, "q_id").orderBy("d", "t_id")  # <= k x P rows per query
    top = cand.withColumn("nn", F.row_number().over(w) - 1).where(F.col("nn") < k)
    return top


def augment(train: DataFrame, cols: list[str], label: str, k: int = 5, pert: float = 0.02, seed: int = 0) -> DataFrame:
    """I4: augmented train rows per key: (regime, repeat, fold, row_id, cols..., label, synthetic)."""
    rel = relevance_table(train, label)
    b = bin_rows(train.select(*KEYS, "row_id", *cols, label), rel, label)
    sizes = b.groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("nbin"))
    per_key = sizes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("nbins"), F.sum("nbin").alias("ntot"),
                                       F.count_if(F.col("bin") != "normal").alias("nrare"))
    ok = per_key.where((F.col("nrare") > 0) & (F.col("nbins") > F.col("nrare")))
    plan = sizes.join(ok, KEYS).withColumn("target", F.floor(F.col("ntot") / F.col("nbins")))
    plan = F.broadcast(plan)  # <= keys x 3 rows
    bb = b.join(plan, [*KEYS, "bin"], "left")
    untouched = bb.where(F.col("target").isNull()).select(*KEYS, "row_id", *cols, label, F.lit(False).alias("synthetic"))
    # bins above the target: keep the first `target` rows in hash order
    above = F.col("target").isNotNull() & (F.col("nbin") > F.col("target"))
    normal = bb.where(above).withColumn(
        "__h", order_key(F.lit(seed), F.lit("under"), F.col("fold"), F.col("repeat"), F.col("row_id")))
    kept = assign_by_rank(normal, [F.col("__h"), F.col("row_id")], hash_bucket(F.col("__h"), 12),
                          [*KEYS, "bin", "target"], lambda r, n: r < F.col("target"), "__keep")
    kept = kept.where("__keep").select(*KEYS, "row_id", *cols, label, F.lit(False).alias("synthetic"))
    rare = bb.where(F.col("target").isNotNull() & (F.col("nbin") <= F.col("target")))
    real_rare = rare.select(*KEYS, "row_id", *cols, label, F.lit(False).alias("synthetic"))
    # synthetic cases: range-normalised features inside the bin, k nearest neighbours
    rng = rare.groupBy(*KEYS, "bin").agg(*[F.min(c).alias(f"__lo{i}") for i, c in enumerate(cols)],
                                         *[F.max(c).alias(f"__hi{i}") for i, c in enumerate(cols)],
                                         *[F.stddev_pop(c).alias(f"__sd{i}") for i, c in enumerate(cols)],
                                         F.stddev_pop(label).alias("__sdy"))
    rz = rare.join(F.broadcast(rng), [*KEYS, "bin"])
    zcols = [f"__z{i}" for i in range(len(cols))]
    rz = rz.select("*", *[((F.col(c) - F.col(f"__lo{i}")) / F.when(F.col(f"__hi{i}") > F.col(f"__lo{i}"),
                                                                   F.col(f"__hi{i}") - F.col(f"__lo{i}")).otherwise(1.0))
                          .alias(f"__z{i}") for i, c in enumerate(cols)])
    rz = materialize(rz)
    nn = _knn_in_bins(rz, zcols, k)
    safe = nn.groupBy(*KEYS, "q_id").agg(F.percentile("d", 0.5).alias("__med"), F.count(F.lit(1)).alias("__kn"))
    # number of synthetic rows per seed case: (target - nbin) spread over the bin's cases
    seeds = rz.join(row_side(safe.withColumnRenamed("q_id", "row_id")), [*KEYS, "row_id"], "left")
    extra = (F.col("target") - F.col("nbin"))
    per = F.floor(extra / F.col("nbin"))
    rem = extra - per * F.col("nbin")
    seeds = seeds.withColumn("__u0", _u(F.lit(seed), F.lit("rem"), F.col("fold"), F.col("repeat"), F.col("row_id")))
    nsyn = per + F.when(F.col("__u0") < rem / F.col("nbin"), 1).otherwise(0)
    nsyn = nsyn.cast("int")
    seeds = seeds.withColumn("__n", nsyn).where("__n > 0").withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    seeds = seeds.withColumn("nn", F.floor(_u(F.lit(seed), F.lit("nn"), F.col("fold"), F.col("repeat"), F.col("row_id"),
                                              F.col("__j")) * F.coalesce(F.col("__kn"), F.lit(1))).cast("int"))
    pick = nn.select(*KEYS, F.col("q_id").alias("row_id"), "nn", F.col("t_id").alias("__nid"), F.col("d").alias("__nd"))
    s = seeds.join(row_side(pick), [*KEYS, "row_id", "nn"], "left")
    other = rz.select(*KEYS, F.col("row_id").alias("__nid"), *[F.col(c).alias(f"__n_{c}") for c in cols],
                      F.col(label).alias("__n_y"))
    s = s.join(row_side(other), [*KEYS, "__nid"], "left")
    interp = F.col("__nid").isNotNull() & (F.col("__nd") < F.col("__med") / 2)
    u = _u(F.lit(seed), F.lit("gap"), F.col("fold"), F.col("repeat"), F.col("row_id"), F.col("__j"))

    def gauss(tag, i):
        u1 = F.greatest(_u(F.lit(seed), F.lit(tag), F.lit(i), F.col("fold"), F.col("repeat"), F.col("row_id"), F.col("__j")),
                        F.lit(1e-12))
        u2 = _u(F.lit(seed), F.lit(tag + "2"), F.lit(i), F.col("fold"), F.col("repeat"), F.col("row_id"), F.col("__j"))
        return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)

    xs = []
    for i, c in enumerate(cols):
        xi = F.col(c) + u * (F.col(f"__n_{c}") - F.col(c))
        xn = F.col(c) + F.lit(pert) * F.col(f"__sd{i}") * gauss("x", i)
        xs.append(F.when(interp, xi).otherwise(xn).alias(c))
    # target of an interpolated case: inverse-distance weighted mean of the two ends
    dn = F.col("__nd")
    d_new_seed = u * dn
    d_new_nn = (F.lit(1.0) - u) * dn
    wy = F.when((d_new_seed + d_new_nn) == 0, (F.col(label) + F.col("__n_y")) / 2).otherwise(
        (F.col(label) * d_new_nn + F.col("__n_y") * d_new_seed) / (d_new_seed + d_new_nn))
    ys = F.when(interp, wy).otherwise(F.col(label) + F.lit(pert) * F.col("__sdy") * gauss("y", 0))
    synth_id = -(F.abs(F.xxhash64(F.col("row_id"), F.col("__j"), F.col("fold"), F.col("repeat"))) + 1)
    synth = s.select(*KEYS, synth_id.alias("row_id"), *xs, ys.alias(label), F.lit(True).alias("synthetic"))
    return untouched.unionByName(kept).unionByName(real_rare).unionByName(synth)
