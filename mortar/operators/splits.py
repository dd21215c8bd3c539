"""Fold tables (E1-E10): hash-ordered, seed-stable and independent of partitioning.

Every split is a long DataFrame, never one DataFrame per fold:

* test-fold map   ``(repeat, row_id, fold)``              - E1, E2, E3, E10
* fold table (F3) ``(regime, repeat, fold, row_id, split)`` with split in train/val/test

Random streams of the study cannot be reproduced; rows are ordered by ``h(seed, id)``
instead, which keeps the exact fold *sizes*, disjointness and per-repeat reseeding.
Group K-fold reproduces the greedy "largest group to the lightest fold" assignment
exactly, but without walking groups one by one on the driver: runs of equal-size groups
are assigned in closed form (see :func:`_run_pieces`), so only the distinct group sizes
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mortar.functions.hashing import hash_bucket, order_key
from mortar.operators.rank import DEFAULT_BUCKET_BITS, assign_by_rank, rank_by_numeric

VAL_FRAC = 0.2
MAX_BROADCAST_PIECES = 2_000_000


def ntile_fold(rn: Column, n: Column, k) -> Column:
    """0-based ``ntile(k)`` from a 0-based rank: first ``n % k`` folds get one extra row."""
    k = F.lit(k) if not isinstance(k, Column) else k
    q = F.floor(n / k).cast("long")
    rem = (n % k).cast("long")
    big = rem * (q + 1)
    return F.when(rn < big, F.floor(rn / (q + 1))).otherwise(
        rem + F.floor((rn - big) / F.greatest(q, F.lit(1)))).cast("int")


def n_val_of(n: Column, frac: float = VAL_FRAC) -> Column:
    """``max(1, round(n * frac))`` with Python's half-even rounding."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(frac), 0).cast("long"))


def _hash_assign(df: DataFrame, hcol: Column, id_col: str, partition_by: list[str], rank_fn, out: str) -> DataFrame:
    tmp = df.withColumn("__h", hcol)
    res = assign_by_rank(tmp, [F.col("__h"), F.col(id_col)], hash_bucket(F.col("__h"), DEFAULT_BUCKET_BITS),
                         partition_by, rank_fn, out)
    return res.drop("__h")


# ----------------------------------------------------------------------------- E1
def kfold(df: DataFrame, k: int = 5, repeats: int = 5, seed: int = 0, id_col: str = "row_id") -> DataFrame:
    """Repeated shuffled K-fold -> ``(repeat, row_id, fold)``; seed of repeat r is seed+r."""
    ids = df.select(F.col(id_col).alias("row_id")).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    res = _hash_assign(ids, order_key(F.col("repeat") + F.lit(seed), F.col("row_id")), "row_id", ["repeat"],
                       lambda r, n: ntile_fold(r, n, k), "fold")
    return res.select("repeat", "row_id", "fold")


# ----------------------------------------------------------------------------- E10
def contiguous_kfold(df: DataFrame, k: int = 5, id_col: str = "row_id") -> DataFrame:
    """Unshuffled K-fold in row order -> ``(row_id, fold)``."""
    ranked = rank_by_numeric(df.select(F.col(id_col).alias("row_id")), "row_id", out="__rn", total_col="__n")
    return ranked.select("row_id", ntile_fold(F.col("__rn"), F.col("__n"), k).alias("fold"))


# ----------------------------------------------------------------------------- E3 / E8
def leave_one_out(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """fold = row position; n folds, never n^2 rows."""
    ranked = rank_by_numeric(df.select(F.col(id_col).alias("row_id")), "row_id", out="fold")
    return ranked.select(F.col("fold").cast("long").alias("fold"), "row_id")


def loo_sampled(df: DataFrame, every: int = 8, id_col: str = "row_id") -> DataFrame:
    """The LOO folds whose (single) test row position is a multiple of ``every``."""
    return leave_one_out(df, id_col).where(F.col("fold") % every == 0)


# ----------------------------------------------------------------------------- E2
def _run_pieces(loads: list[int], s: int, m: int) -> tuple[list[tuple], list[int]]:
    """Closed-form greedy for ``m`` groups of equal size ``s`` given fold ``loads``.

    Greedy picks argmin (load, fold). Fold f would be picked at keys ``loads[f] + j*s``
    (j = 0, 1, ...), so the pick order is the sorted merge of k arithmetic sequences.
    With ``q_f, r_f = divmod(loads[f], s)`` the key ``(q_f + j) * s + r_f`` sorts by
    level ``t = q_f + j`` then ``(r_f, f)``; at level t the folds with ``q_f <= t`` are
    picked in ``(r_f, f)`` order. Between consecutive distinct ``q`` values the present
    set is fixed, giving at most k pieces ``[start, end)`` over the run's pick index.
    """
    k = len(loads)
    q = [L // s for L in loads]
    r = [L % s for L in loads]
    levels = sorted(set(q))
    pieces, counts = [], [0] * k
    start, remaining = 0, m
    for j, u in enumerate(levels):
        present = sorted((f for f in range(k) if q[f] <= u), key=lambda f: (r[f], f))
        c = len(present)
        take = remaining if j + 1 == len(levels) else min(remaining, c * (levels[j + 1] - u))
        if take > 0:
            pieces.append((start, start + take, c, present))
            full, extra = divmod(take, c)
            for idx, f in enumerate(present):
                counts[f] += full + (1 if idx < extra else 0)
        start += take
        remaining -= take
        if remaining == 0:
            break
    return pieces, [loads[f] + counts[f] * s for f in range(k)]


def greedy_pieces(runs: list[tuple], k_of: dict) -> list[tuple]:
    """Pieces for every (partition, size) run; ``runs`` = (part, size, m) sorted by size desc."""
    loads: dict = {}
    out = []
    for part, s, m in runs:
        k = k_of[part]
        L = loads.get(part, [0] * k)
        pieces, loads[part] = _run_pieces(L, int(s), int(m))
        out.extend((part, int(s), a, b, c, fs) for a, b, c, fs in pieces)
    return out


def group_kfold_assign(grouped: DataFrame, k: int = 5, partition_by: list[str] | tuple[str, ...] = (),
                       cap_by_groups: bool = False, min_k: int = 1, out: str = "fold") -> DataFrame:
    """``(*partition_by, group_id, fold)`` exactly as the greedy group K-fold assigns.

    Groups are taken by size desc, ties by group code desc. Only the (partition, size,
    count) runs reach the driver. With ``cap_by_groups`` the number of folds of a
    partition is ``max(min_k, min(k, #groups))`` (inner stacking folds).
    """
    parts = list(partition_by)
    sizes = grouped.groupBy(*parts, "group_id").agg(F.count(F.lit(1)).alias("gsize"))
    part_key = F.to_json(F.struct(*[F.col(p) for p in parts])) if parts else F.lit("")
    sizes = sizes.withColumn("__part", part_key)
    run_rows = sizes.groupBy("__part", "gsize").agg(F.count(F.lit(1)).alias("m")).collect()
    n_groups: dict = {}
    for r in run_rows:
        n_groups[r["__part"]] = n_groups.get(r["__part"], 0) + r["m"]
    k_of = {p: (max(min_k, min(k, g)) if cap_by_groups else k) for p, g in n_groups.items()}
    runs = sorted(((r["__part"], r["gsize"], r["m"]) for r in run_rows), key=lambda t: (t[0], -t[1]))
    pieces = greedy_pieces(runs, k_of)
    spark = grouped.sparkSession
    schema = T.StructType([
        T.StructField("__part", T.StringType()), T.StructField("gsize", T.LongType()),
        T.StructField("__start", T.LongType()), T.StructField("__end", T.LongType()),
        T.StructField("__c", T.LongType()), T.StructField("__folds", T.ArrayType(T.IntegerType())),
    ])
    pdf = spark.createDataFrame(pieces, schema)
    if len(pieces) <= MAX_BROADCAST_PIECES:  # pieces <= k x #distinct sizes: bounded
        pdf = F.broadcast(pdf)
    ranked = rank_by_numeric(sizes, "group_id", partition_by=["__part", "gsize"], out="__i", descending=True)
    joined = ranked.join(pdf, on=["__part", "gsize"]).where(
        (F.col("__i") >= F.col("__start")) & (F.col("__i") < F.col("__end")))
    fold = F.element_at(F.col("__folds"), (F.pmod(F.col("__i") - F.col("__start"), F.col("__c")) + 1).cast("int"))
    return joined.select(*parts, "group_id", fold.alias(out))


def group_kfold(grouped: DataFrame, k: int = 5, id_col: str = "row_id") -> DataFrame:
    """E2 applied to rows: ``(repeat=0, row_id, fold)``."""
    gmap = group_kfold_assign(grouped, k)
    return grouped.select(F.col(id_col).alias("row_id"), "group_id").join(gmap, "group_id").select(
        F.lit(0).alias("repeat"), "row_id", "fold")


# ----------------------------------------------------------------------------- E4 / E5 -> F3
def _expand_folds(test_map: DataFrame, k: int) -> DataFrame:
    """(repeat, row_id, test fold) -> one row per (repeat, fold, row_id) with is_test."""
    return test_map.withColumnRenamed("fold", "__tf").withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(
        "__is_test", F.col("fold") == F.col("__tf")).drop("__tf")


def inner_random_split(test_map: DataFrame, k: int, seed: int = 0, frac: float = VAL_FRAC,
                       regime: str = "random") -> DataFrame:
    """F3 fold table; val = first ``max(1, round(0.2 n_trainval))`` rows by hash."""
    ex = _expand_folds(test_map, k)
    tv = ex.where(~F.col("__is_test"))
    hv = order_key(F.lit(seed), F.lit("v"), F.col("repeat"), F.col("fold"), F.col("row_id"))
    val = lambda r, n: F.when(r < n_val_of(n, frac), "val").otherwise("train")
    tv_split = _hash_assign(tv, hv, "row_id", ["repeat", "fold"], val, "split").select("repeat", "fold", "row_id", "split")
    test = ex.where(F.col("__is_test")).select("repeat", "fold", "row_id", F.lit("test").alias("split"))
    return tv_split.unionByName(test).select(F.lit(regime).alias("regime"), "repeat", "fold", "row_id", "split")


def inner_group_split(test_map: DataFrame, grouped: DataFrame, k: int, seed: int = 0,
                      frac: float = VAL_FRAC, regime: str = "group") -> DataFrame:
    """E5: F3 fold table; val = first ``max(1, round(0.2 #groups))`` trainval groups by hash."""
    from mortar.session import row_side
    ex = _expand_folds(test_map.join(row_side(grouped.select("row_id", "group_id")), "row_id"), k)
    tv = ex.where(~F.col("__is_test"))
    tv_groups = tv.select("repeat", "fold", "group_id").distinct()
    hv = order_key(F.lit(seed), F.lit("g"), F.col("repeat"), F.col("fold"), F.col("group_id"))
    val = lambda r, n: F.when(r < n_val_of(n, frac), "val").otherwise("train")
    gsplit = _hash_assign(tv_groups, hv, "group_id", ["repeat", "fold"], val, "split").select(
        "repeat", "fold", "group_id", "split")
    tv_split = tv.join(gsplit, ["repeat", "fold", "group_id"]).select("repeat", "fold", "row_id", "split")
    test = ex.where(F.col("__is_test")).select("repeat", "fold", "row_id", F.lit("test").alias("split"))
    return tv_split.unionByName(test).select(F.lit(regime).alias("regime"), "repeat", "fold", "row_id", "split")


def fold_table(df: DataFrame, regime: str, k: int = 5, repeats: int = 5, seed: int = 0,
               grouped: DataFrame | None = None, data: DataFrame | None = None) -> DataFrame:
    """F3 for a regime: ``random`` (E1+E4) or ``group`` (E2+E5; repeats forced to 1).

    ``data`` (``row_id, ..``): its other columns are joined, in the random regime before a row is
    repeated for each fold, so that the long table is neither shuffled nor written."""
    from mortar.operators import marks as MK
    from mortar.session import materialize, row_side
    if regime == "random":
        return random_folds(df, k, repeats, seed, data)[1]
    if regime == "group":
        if grouped is None:
            raise ValueError("group regime needs group ids")
        marked = materialize(MK.group_marks(grouped.select("row_id", "group_id"), k, seed)).drop("group_id")
        copies = marked.join(row_side(grouped.select("row_id")), "row_id")  # a row for each pair of copies of an id
        return with_data(MK.fold_rows(copies, k, regime).select("regime", "repeat", "fold", "row_id", "split"), data)
    raise ValueError(f"unknown regime {regime!r}")


def random_marks(df: DataFrame, k: int = 5, repeats: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """The ids, written, and with their folds as columns (:mod:`mortar.operators.marks`; None if a cut parts copies)."""
    from mortar.operators import marks as MK
    from mortar.session import materialize
    df = materialize(df.select("row_id"), spread=True)  # an id is hashed for every (repeat, fold)
    marked = MK.fold_marks(df, k, repeats, seed, whole_copies=False)
    return df, None if marked is None else materialize(marked, spread=True)


def random_folds(df: DataFrame, k: int = 5, repeats: int = 5, seed: int = 0,
                 data: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """F3 of the random regime, and the same rows with the other columns of ``data``."""
    from mortar.operators import marks as MK
    from mortar.session import materialize, row_side
    df, marked = random_marks(df, k, repeats, seed)
    if marked is None:  # a cut between copies of one id: only ranks tell which of them come first
        plain = inner_random_split(materialize(kfold(df, k, repeats, seed)), k, seed)
        plain = plain if data is None else materialize(plain)
        return plain, with_data(plain, data)
    names = ["regime", "repeat", "fold", "row_id", "split"]
    plain = MK.fold_rows(marked, k, "random").select(*names)
    if data is None:
        return plain, plain
    both = MK.fold_rows(marked.join(row_side(data), "row_id"), k, "random")
    return plain, both.select(*names, *[c for c in data.columns if c != "row_id"])


def with_data(folds: DataFrame, data: DataFrame | None) -> DataFrame:
    """``folds`` with the columns of ``data`` (``row_id, ..``); as it is where it has them already."""
    from mortar.session import row_side
    if data is None or set(data.columns) <= set(folds.columns):
        return folds
    return folds.join(row_side(data), "row_id")


# ----------------------------------------------------------------------------- E6
def oof_folds_random(folds: DataFrame, inner_k: int = 5, seed: int = 0, rows: DataFrame | None = None) -> DataFrame:
    """E6 (random): inner K-fold over each outer train part -> (repeat, fold, row_id, inner_fold).

    The first row of each inner fold is found by counts; the rest is a comparison with it. ``rows``:
    ``folds`` with further columns, which are kept unless a cut parts copies of one id."""
    from mortar.operators import marks as MK
    from mortar.session import materialize
    keys = ["repeat", "fold"]
    hv = order_key(F.lit(seed), F.lit("oof"), F.col("repeat"), F.col("fold"), F.col("row_id"))
    train = F.col("split") == "train"
    tr = folds.where(train).select(*keys, "row_id")
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.lit(inner_k - 1)),
                                   lambda f: f * F.floor(n / inner_k) + F.least(f, n % inner_k))
    cuts = MK.hash_cuts(tr.withColumn("__h", hv), keys, starts)
    rest = [c for c in rows.columns if c not in ("regime", "repeat", "fold", "row_id", "split")] if rows is not None else []
    if MK.parts_copies(cuts):
        res = _hash_assign(tr, hv, "row_id", keys, lambda r, n: ntile_fold(r, n, inner_k), "inner_fold")
        return materialize(res.select(*keys, "row_id", "inner_fold"))
    id_type = folds.schema["row_id"].dataType.simpleString()
    table = folds.sparkSession.createDataFrame(
        [(*key, [found.get(i, (None, None))[:2] for i in range(inner_k - 1)]) for key, found in cuts.items()],
        f"repeat int, fold int, __cuts array<struct<h: string, id: {id_type}>>")
    own = (folds if rows is None else rows).where(train).select(*keys, "row_id", *rest)
    own = own.withColumn("__h", hv).join(F.broadcast(table), keys, "left")  # one row for each fold
    past = F.size(F.filter("__cuts", lambda c: (F.col("__h") > c["h"]) | (
        (F.col("__h") == c["h"]) & (F.col("row_id") >= c["id"]))))
    return own.select(*keys, "row_id", F.when(F.col("__cuts").isNull(), 0).otherwise(past).alias("inner_fold"), *rest)


def oof_folds_group(folds: DataFrame, grouped: DataFrame, inner_k: int = 5, min_k: int = 2) -> DataFrame:
    """E6 (group): greedy group K-fold inside each outer train part, ``max(2, min(5, #groups))`` folds."""
    tr = folds.where(F.col("split") == "train").select("repeat", "fold", "row_id").join(
        grouped.select("row_id", "group_id"), "row_id")
    gmap = group_kfold_assign(tr, inner_k, partition_by=["repeat", "fold"], cap_by_groups=True, min_k=min_k,
                              out="inner_fold")
    return tr.join(gmap, ["repeat", "fold", "group_id"]).select(
        "repeat", "fold", "row_id", "inner_fold")


# ----------------------------------------------------------------------------- E7 / E9
def split_guard(folds: DataFrame, min_train: int = 5, min_val: int = 2) -> DataFrame:
    """Per-fold sizes and whether the fold passes the size guard."""
    sizes = folds.groupBy("regime", "repeat", "fold").agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "val").alias("n_val"),
        F.count_if(F.col("split") == "test").alias("n_test"))
    return sizes.withColumn("usable", (F.col("n_train") >= min_train) & (F.col("n_val") >= min_val))


def leakage_audit(folds: DataFrame, grouped: DataFrame) -> DataFrame:
    """Per fold, groups whose rows sit on both sides of the test boundary."""
    side = with_data(folds, grouped.select("row_id", "group_id")).withColumn("__t", F.col("split") == "test")
    per = side.groupBy("regime", "repeat", "fold", "group_id").agg(
        F.max(F.col("__t").cast("int")).alias("__in_test"), F.min(F.col("__t").cast("int")).alias("__all_test"))
    return per.groupBy("regime", "repeat", "fold").agg(
        F.count_if((F.col("__in_test") == 1) & (F.col("__all_test") == 0)).alias("n_straddling"),
        F.count_if(F.col("__in_test") == 1).alias("n_test_groups"))


def plain_folds(test_map: DataFrame, k: int, regime: str) -> DataFrame:
    """F3 without an inner validation split: every non-test row is train."""
    ex = _expand_folds(test_map, k)
    return ex.select(F.lit(regime).alias("regime"), "repeat", "fold", "row_id",
                     F.when(F.col("__is_test"), "test").otherwise("train").alias("split"))
