"""Catalog part 1: features (C), groups (D), splits (E) over the ``mix`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from mortar.functions import features as fx
from mortar.operators import groups as G
from mortar.operators import splits as S
from mortar.plans import sql_blocks as Q
from mortar.plans.registry import query, r6, round_sql, with_ctes
from mortar.session import materialize
from mortar.sources.tables import RAW_FEATURES, TARGET, mix_valid

# ----------------------------------------------------------------------------- C


@query("features_all", with_ctes("SELECT row_id, " + ", ".join(
    f"{v} AS {k}" for k, v in Q.DERIVED_SQL.items()) + " FROM mixv", mixv=Q.MIXV))
def features_all(spark, sf):
    return fx.with_derived(mix_valid(spark, sf)).select("row_id", *fx.DERIVED)


def _fset_sql(cols):
    sel = ", ".join(f"{Q.DERIVED_SQL.get(c, c)} AS {c}" for c in cols)
    return with_ctes(f"SELECT row_id, {sel}, {TARGET} FROM mixv", mixv=Q.MIXV)


@query("features_raw", _fset_sql(RAW_FEATURES))
def features_raw(spark, sf):
    return fx.engineer(mix_valid(spark, sf), "raw", TARGET)


@query("features_engineered", _fset_sql(fx.ENGINEERED_12))
def features_engineered(spark, sf):
    return fx.engineer(mix_valid(spark, sf), "engineered", TARGET)


@query("features_both", _fset_sql(list(dict.fromkeys(RAW_FEATURES + fx.ENGINEERED_12))))
def features_both(spark, sf):
    return fx.engineer(mix_valid(spark, sf), "both", TARGET)


def _serve_sql(kind):
    if kind == "strength":
        cols = {"total_binder": Q.DERIVED_SQL["total_binder"], "ggbfs_fraction": Q.DERIVED_SQL["ggbfs_fraction"],
                "total_activator": Q.DERIVED_SQL["total_activator"],
                "na2sio3_naoh_ratio": "na2sio3 / (naoh + 1e-9)", "naoh_molarity": "naoh_molarity",
                "w_b_ratio": Q.DERIVED_SQL["w_b_ratio"], "curing_temp_c": "curing_temp_c",
                "curing_time_hr": "curing_time_hr", "sp": "sp"}
    else:
        cols = {"total_binder": Q.DERIVED_SQL["total_binder"], "ggbfs_fraction": Q.DERIVED_SQL["ggbfs_fraction"],
                "total_activator": Q.DERIVED_SQL["total_activator"], "naoh_molarity": "naoh_molarity",
                "activator_binder_ratio": "activator_binder_ratio", "w_b_ratio": Q.DERIVED_SQL["w_b_ratio"],
                "rca_fraction": Q.DERIVED_SQL["rca_fraction"], "curing_time_hr": "curing_time_hr", "sp": "sp"}
    sel = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return with_ctes(f"SELECT row_id, {sel} FROM mix")


@query("serve_features_strength", _serve_sql("strength"))
def serve_features_strength(spark, sf):
    from mortar.sources.tables import mix
    return fx.serve_features_strength(mix(spark, sf))


@query("serve_features_slump", _serve_sql("slump"))
def serve_features_slump(spark, sf):
    from mortar.sources.tables import mix
    return fx.serve_features_slump(mix(spark, sf))


# ----------------------------------------------------------------------------- D


def _grouped(spark, sf, relaxed=False):
    base = mix_valid(spark, sf)
    return G.assign_groups_relaxed(base) if relaxed else G.assign_groups(base)


GROUP_CTES = dict(mixv=Q.MIXV, **Q.group_sql())
RELAXED_CTES = dict(mixv=Q.MIXV, **Q.group_sql(keys=("flyash", "ggbfs", "na2sio3_naoh_ratio"), scale="100.0"))


@query("group_strict", with_ctes("SELECT row_id, group_id FROM grp", **GROUP_CTES))
def group_strict(spark, sf):
    return _grouped(spark, sf).select("row_id", "group_id")


@query("group_relaxed", with_ctes("SELECT row_id, group_id FROM grp", **RELAXED_CTES))
def group_relaxed(spark, sf):
    return _grouped(spark, sf, relaxed=True).select("row_id", "group_id")


@query("group_sizes", with_ctes(
    "SELECT group_id, count(*) AS n_rows FROM grp GROUP BY group_id ORDER BY n_rows DESC, group_id LIMIT 10",
    **GROUP_CTES))
def group_sizes(spark, sf):
    return G.group_sizes(_grouped(spark, sf), 10)


@query("group_summary", round_sql(with_ctes(
    "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, avg(n) AS mean_size, "
    "CAST(median(n) AS DOUBLE) AS median_size, CAST(max(n) AS BIGINT) AS max_size, "
    "CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS n_singletons FROM sz",
    **GROUP_CTES, sz="SELECT group_id, count(*) AS n FROM grp GROUP BY group_id"), ["mean_size", "median_size"]))
def group_summary(spark, sf):
    return r6(G.group_summary(_grouped(spark, sf)))


@query("hist_group_sizes", with_ctes(
    "SELECT group_size, count(*) AS n_groups FROM (SELECT group_id, count(*) AS group_size FROM grp GROUP BY group_id) "
    "GROUP BY group_size", **GROUP_CTES))
def hist_group_sizes(spark, sf):
    return G.group_size_histogram(_grouped(spark, sf))


# ----------------------------------------------------------------------------- E

KF_CTES = dict(mixv=Q.MIXV, kf=Q.kfold_sql())


@query("split_kfold", with_ctes("SELECT repeat, row_id, fold FROM kf", **KF_CTES))
def split_kfold(spark, sf):
    return S.kfold(mix_valid(spark, sf), 5, 5, 0)


@query("split_inner_random", with_ctes("SELECT * FROM folds", **KF_CTES, **Q.inner_random_sql()))
def split_inner_random(spark, sf):
    return S.fold_table(mix_valid(spark, sf), "random", 5, 5, 0)


GKF_CTES = dict(**GROUP_CTES, **Q.group_kfold_sql())


def recursive(sql: str) -> str:
    return sql if "WITH RECURSIVE" in sql else sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("split_group_kfold", recursive(with_ctes(
    "SELECT 0 AS repeat, grp.row_id, gmap.fold FROM grp JOIN gmap USING (group_id)", **GKF_CTES)))
def split_group_kfold(spark, sf):
    return S.group_kfold(_grouped(spark, sf), 5)


@query("split_inner_group", recursive(with_ctes("SELECT * FROM gfolds", **GKF_CTES, **Q.inner_group_sql())))
def split_inner_group(spark, sf):
    return S.fold_table(mix_valid(spark, sf), "group", grouped=_grouped(spark, sf))


@query("split_loo", with_ctes("SELECT row_number() OVER (ORDER BY row_id) - 1 AS fold, row_id FROM mixv", mixv=Q.MIXV))
def split_loo(spark, sf):
    return S.leave_one_out(mix_valid(spark, sf))


@query("split_loo_sampled", with_ctes(
    "SELECT fold, row_id FROM (SELECT row_number() OVER (ORDER BY row_id) - 1 AS fold, row_id FROM mixv) WHERE fold % 8 = 0",
    mixv=Q.MIXV))
def split_loo_sampled(spark, sf):
    return S.loo_sampled(mix_valid(spark, sf), 8)


@query("split_contiguous", with_ctes(
    "SELECT row_id, CAST(ntile(5) OVER (ORDER BY row_id) - 1 AS INTEGER) AS fold FROM mixv", mixv=Q.MIXV))
def split_contiguous(spark, sf):
    return S.contiguous_kfold(mix_valid(spark, sf), 5)


@query("split_guard", with_ctes(
    "SELECT regime, repeat, fold, count(*) FILTER (WHERE split = 'train') AS n_train, "
    "count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test, "
    "(count(*) FILTER (WHERE split = 'train') >= 5 AND count(*) FILTER (WHERE split = 'val') >= 2) AS usable "
    "FROM folds GROUP BY regime, repeat, fold", **KF_CTES, **Q.inner_random_sql()))
def split_guard(spark, sf):
    return S.split_guard(S.fold_table(mix_valid(spark, sf), "random", 5, 5, 0))


def _oof_sql():
    from mortar.functions.hashing import h_sql
    hv = h_sql("0", "'oof'", "repeat", "fold", "row_id")
    return (f"SELECT repeat, fold, row_id, CAST(ntile(5) OVER (PARTITION BY repeat, fold ORDER BY {hv}, row_id) - 1 AS INTEGER) "
            f"AS inner_fold FROM folds WHERE split = 'train'")


@query("split_oof", with_ctes(_oof_sql(), **KF_CTES, **Q.inner_random_sql()))
def split_oof(spark, sf):
    folds = S.fold_table(mix_valid(spark, sf), "random", 5, 5, 0)
    return S.oof_folds_random(folds, 5, 0)


@query("leakage_audit", recursive(with_ctes(
    "SELECT regime, repeat, fold, count(*) FILTER (WHERE in_test = 1 AND all_test = 0) AS n_straddling, "
    "count(*) FILTER (WHERE in_test = 1) AS n_test_groups FROM ("
    " SELECT regime, repeat, fold, group_id, max(CAST(split = 'test' AS INTEGER)) AS in_test, "
    " min(CAST(split = 'test' AS INTEGER)) AS all_test FROM allf JOIN grp USING (row_id) "
    " GROUP BY regime, repeat, fold, group_id) GROUP BY regime, repeat, fold",
    **{**KF_CTES, **Q.inner_random_sql(), **GKF_CTES, **Q.inner_group_sql(),
       "allf": "SELECT * FROM folds UNION ALL SELECT * FROM gfolds"})))
def leakage_audit(spark, sf):
    base = mix_valid(spark, sf)
    grouped = materialize(G.assign_groups(base).select("row_id", "group_id"))
    rnd = S.fold_table(base, "random", 5, 5, 0, data=grouped)
    grp = S.fold_table(base, "group", grouped=grouped, data=grouped)
    return S.leakage_audit(rnd.unionByName(grp), grouped)
