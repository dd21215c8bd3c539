"""Reusable DuckDB SQL fragments for the oracles (the Spark side never uses these)."""

from __future__ import annotations

from mortar.functions.hashing import h_sql

EPS = "1e-9"

DERIVED_SQL = {
    "total_binder": "(flyash + ggbfs)",
    "ggbfs_fraction": f"ggbfs / ((flyash + ggbfs) + {EPS})",
    "total_activator": "(na2sio3 + naoh)",
    "w_b_ratio": f"water / ((flyash + ggbfs) + {EPS})",
    "total_aggregate": "(((nca + rca) + sand) + r_sand)",
    "rca_fraction": f"rca / ((((nca + rca) + sand) + r_sand) + {EPS})",
    "r_sand_fraction": f"r_sand / ((((nca + rca) + sand) + r_sand) + {EPS})",
    "nca_fraction": f"nca / ((((nca + rca) + sand) + r_sand) + {EPS})",
    "sand_fraction": f"sand / ((((nca + rca) + sand) + r_sand) + {EPS})",
}

MIXV = "SELECT * FROM mix WHERE compressive_strength_mpa IS NOT NULL"

FEAT_SQL = "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in DERIVED_SQL.items()) + " FROM mixv"


def group_sql(src: str = "mixv", keys=("flyash", "ggbfs", "na2sio3", "naoh", "naoh_molarity",
                                       "activator_binder_ratio"), scale: str = "1000.0") -> dict:
    kcols = ", ".join(f"CAST(round_even({c} * {scale}, 0) AS BIGINT) AS k{i}" for i, c in enumerate(keys))
    klist = ", ".join(f"k{i}" for i in range(len(keys)))
    return {
        "keyed": f"SELECT row_id, {kcols} FROM {src}",
        "firsts": f"SELECT {klist}, min(row_id) AS first_row FROM keyed GROUP BY {klist}",
        "codes": f"SELECT {klist}, row_number() OVER (ORDER BY first_row) - 1 AS group_id FROM firsts",
        "grp": f"SELECT keyed.row_id, codes.group_id FROM keyed JOIN codes USING ({klist})",
    }


def kfold_sql(src: str = "mixv", k: int = 5, repeats: int = 5, seed: int = 0) -> str:
    hv = h_sql(f"r.rep + {seed}", "m.row_id")
    return (f"SELECT CAST(r.rep AS INTEGER) AS repeat, m.row_id, "
            f"CAST(ntile({k}) OVER (PARTITION BY r.rep ORDER BY {hv}, m.row_id) - 1 AS INTEGER) AS fold "
            f"FROM {src} m, range(0, {repeats}) r(rep)")


def inner_random_sql(kf: str = "kf", k: int = 5, seed: int = 0, regime: str = "random") -> dict:
    hv = h_sql(str(seed), "'v'", "repeat", "fold", "row_id")
    return {
        "ex": f"SELECT kf.repeat, CAST(f.fo AS INTEGER) AS fold, kf.row_id, kf.fold = f.fo AS is_test "
              f"FROM {kf} kf, range(0, {k}) f(fo)",
        "tv": f"SELECT repeat, fold, row_id, row_number() OVER (PARTITION BY repeat, fold ORDER BY {hv}, row_id) - 1 AS rn, "
              f"count(*) OVER (PARTITION BY repeat, fold) AS n FROM ex WHERE NOT is_test",
        "folds": f"SELECT '{regime}' AS regime, repeat, fold, row_id, CASE WHEN rn < greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) "
                 f"THEN 'val' ELSE 'train' END AS split FROM tv "
                 f"UNION ALL SELECT '{regime}', repeat, fold, row_id, 'test' FROM ex WHERE is_test",
    }


def group_kfold_sql(grp: str = "grp", k: int = 5) -> dict:
    """Exact greedy (largest group to the lightest fold) as a recursive walk."""
    zeros = ", ".join(["0"] * k)
    return {
        "gsz": f"SELECT group_id, count(*) AS sz, row_number() OVER (ORDER BY count(*) DESC, group_id DESC) AS i "
               f"FROM {grp} GROUP BY group_id",
        "walk": f"SELECT 0 AS i, CAST([{zeros}] AS BIGINT[]) AS loads, CAST(NULL AS BIGINT) AS group_id, CAST(NULL AS INTEGER) AS fold "
                f"UNION ALL SELECT s.i, list_transform(range({k}), lambda x: CASE WHEN x = list_position(w.loads, list_min(w.loads)) - 1 "
                f"THEN w.loads[x + 1] + s.sz ELSE w.loads[x + 1] END), s.group_id, "
                f"CAST(list_position(w.loads, list_min(w.loads)) - 1 AS INTEGER) FROM walk w JOIN gsz s ON s.i = w.i + 1",
        "gmap": "SELECT group_id, fold FROM walk WHERE group_id IS NOT NULL",
    }


def inner_group_sql(k: int = 5, seed: int = 0, regime: str = "group") -> dict:
    hv = h_sql(str(seed), "'g'", "repeat", "fold", "group_id")
    return {
        "gkf": "SELECT 0 AS repeat, grp.row_id, gmap.fold FROM grp JOIN gmap USING (group_id)",
        "gex": f"SELECT gkf.repeat, CAST(f.fo AS INTEGER) AS fold, gkf.row_id, grp.group_id, gkf.fold = f.fo AS is_test "
               f"FROM gkf JOIN grp USING (row_id), range(0, {k}) f(fo)",
        "tvg": f"SELECT DISTINCT repeat, fold, group_id FROM gex WHERE NOT is_test",
        "tvr": f"SELECT repeat, fold, group_id, row_number() OVER (PARTITION BY repeat, fold ORDER BY {hv}, group_id) - 1 AS rn, "
               f"count(*) OVER (PARTITION BY repeat, fold) AS n FROM tvg",
        "gfolds": f"SELECT '{regime}' AS regime, CAST(gex.repeat AS INTEGER) AS repeat, gex.fold, gex.row_id, "
                  f"CASE WHEN tvr.rn < greatest(1, CAST(round_even(tvr.n * 0.2, 0) AS BIGINT)) THEN 'val' ELSE 'train' END AS split "
                  f"FROM gex JOIN tvr USING (repeat, fold, group_id) WHERE NOT gex.is_test "
                  f"UNION ALL SELECT '{regime}', CAST(repeat AS INTEGER), fold, row_id, 'test' FROM gex WHERE is_test",
    }


METRIC_NAMES = ["MAE", "MSE", "RMSE", "R2", "LMI", "EAE", "VAF", "STD"]


def metrics_sql(pred: str, keys: list[str]) -> dict:
    """G1-G8 per keys over CTE ``pred`` (actual, predicted)."""
    k = ", ".join(keys)
    return {
        "mb": f"SELECT {k}, avg(actual) AS ybar FROM {pred} GROUP BY {k}",
        "agg": (f"SELECT {k}, count(*) AS n, avg(abs(predicted - actual)) AS MAE, "
                f"avg((predicted - actual) * (predicted - actual)) AS MSE, "
                f"sum((predicted - actual) * (predicted - actual)) AS sse, sum((actual - ybar) * (actual - ybar)) AS sst, "
                f"sum(abs(predicted - actual)) AS sae, sum(abs(actual - ybar)) AS sad, "
                f"avg(abs(predicted - actual) / greatest(abs(actual), 1e-9)) AS EAE, "
                f"var_pop(predicted - actual) AS var_e, var_pop(actual) AS var_y, stddev_pop(predicted - actual) AS STD "
                f"FROM {pred} JOIN mb USING ({k}) GROUP BY {k}"),
        "met": (f"SELECT {k}, n, MAE, MSE, sqrt(MSE) AS RMSE, "
                f"CASE WHEN n < 2 THEN NULL WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / sst END AS R2, "
                f"CASE WHEN sad = 0 THEN NULL ELSE 1 - sae / sad END AS LMI, EAE, "
                f"CASE WHEN var_y = 0 THEN NULL ELSE 100 * (1 - var_e / var_y) END AS VAF, STD FROM agg"),
    }


FIXTURE_PRED = ("SELECT 'fixture' AS model, 'raw' AS feature_set, f.regime, f.repeat, f.fold, f.split, f.row_id, "
                "m.compressive_strength_mpa AS actual, 20.0 + m.ggbfs / 20.0 AS predicted FROM folds f JOIN mixv m USING (row_id)")


def _r(e: str) -> str:
    return f"(CASE WHEN abs({e}) < 1e12 THEN floor(({e}) * 1000000.0 + 0.5) / 1000000.0 ELSE ({e}) END)"


def score_table_sql() -> dict:
    from mortar.plans.fixtures import CV_NAMES, MODEL_NAMES
    models = "[" + ", ".join(f"'{m}'" for m in MODEL_NAMES) + "]"
    cvs = "[" + ", ".join(f"'{c}'" for c in CV_NAMES) + "]"
    test = (f"CASE WHEN model = 'KNN' AND feature_set = 'raw' AND cv = 'SMOGN_GroupKFold' THEN -12.5 "
            f"WHEN model IN ('Ridge', 'Lasso') AND feature_set = 'raw' AND cv = 'random_5x5' THEN 0.61 "
            f"ELSE {_r('0.98 - a / 100.0')} END")
    cols = {
        "train_r2_mean": _r("least(0.999, test_r2_mean + 0.05 + s / 100.0)"),
        "train_r2_std": _r("s / 1000.0"),
        "val_r2_mean": _r("test_r2_mean + ps / 10000.0"),
        "val_r2_std": _r("s / 300.0"),
        "test_r2_std": _r("s / 200.0"),
    }
    for split, fac in (("train", 0.5), ("val", 0.9), ("test", 1.0)):
        cols[f"{split}_mae_mean"] = _r(f"pr / 100.0 * {fac}")
        cols[f"{split}_mae_std"] = _r(f"ps / 1000.0 * {fac}")
        cols[f"{split}_rmse_mean"] = _r(f"pr / 100.0 * {fac} * 1.25")
        cols[f"{split}_rmse_std"] = _r(f"ps / 1000.0 * {fac} * 1.1")
    from mortar.plans.fixtures import SCORE_COLS
    tuned = "cv IN ('random_5x5', 'GroupKFold') AND feature_set = 'engineered_12'"
    sel = ", ".join(f"{cols[c]} AS {c}" if c != "test_r2_mean" else "test_r2_mean" for c in SCORE_COLS)
    return {
        "sbase": (f"SELECT {models}[(CAST(substr(p_brand, 7) AS INTEGER) - 1) % 18 + 1] AS model, "
                  f"CASE WHEN p_size % 2 = 0 THEN 'engineered_12' ELSE 'raw' END AS feature_set, "
                  f"{cvs}[p_partkey % 4 + 1] AS cv, p_size, p_retailprice FROM part"),
        "sagg": ("SELECT model, feature_set, cv, avg(p_size) AS a, stddev_pop(p_size) AS s, avg(p_retailprice) AS pr, "
                 "stddev_pop(p_retailprice) AS ps, count(*) AS n FROM sbase "
                 "WHERE NOT (model = 'PLS' AND cv = 'SMOGN_random') GROUP BY model, feature_set, cv"),
        "st1": f"SELECT model, feature_set, cv, {test} AS test_r2_mean, a, s, pr, ps, n FROM sagg",
        "st2": f"SELECT model, feature_set, cv, {sel}, n FROM st1",
        "scores": (f"SELECT model, feature_set, cv, {', '.join(SCORE_COLS)}, {_r('train_r2_mean - test_r2_mean')} AS overfit_gap, "
                   f"CASE WHEN {tuned} THEN {_r('val_r2_mean - 0.01')} END AS best_optuna_val, "
                   f"CASE WHEN {tuned} THEN CAST(100 AS DOUBLE) END AS n_trials, CASE WHEN {tuned} THEN CAST(n AS DOUBLE) * 0.25 END AS tune_seconds FROM st2"),
    }
