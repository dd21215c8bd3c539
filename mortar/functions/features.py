"""Row-wise feature engineering as Catalyst expressions (no UDF).

Ratios add ``eps`` to the denominator exactly as the study does, so a zero binder gives
``ggbfs_fraction = 0`` but ``w_b_ratio = water * 1e9``; ``try_divide`` would change that.
"""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mortar.sources.tables import RAW_FEATURES

EPS = 1e-9

# The engineered_12 feature list, in the study's order.
ENGINEERED_12 = [
    "total_binder", "ggbfs_fraction", "total_activator", "na2sio3_naoh_ratio",
    "naoh_molarity", "activator_binder_ratio", "w_b_ratio", "rca_fraction",
    "r_sand_fraction", "curing_temp_c", "curing_time_hr", "sp",
]

# The columns each serving app derives (engineered_9 of each study).
STRENGTH_SERVE_9 = [
    "total_binder", "ggbfs_fraction", "total_activator", "na2sio3_naoh_ratio",
    "naoh_molarity", "w_b_ratio", "curing_temp_c", "curing_time_hr", "sp",
]
SLUMP_SERVE_9 = [
    "total_binder", "ggbfs_fraction", "total_activator", "naoh_molarity",
    "activator_binder_ratio", "w_b_ratio", "rca_fraction", "curing_time_hr", "sp",
]

DERIVED = [
    "total_binder", "ggbfs_fraction", "total_activator", "w_b_ratio", "total_aggregate",
    "rca_fraction", "r_sand_fraction", "nca_fraction", "sand_fraction",
]


def derived_columns(eps: float = EPS) -> dict[str, Column]:
    """The nine derived columns over the raw mix columns."""
    c = F.col
    binder = c("flyash") + c("ggbfs")
    aggregate = c("nca") + c("rca") + c("sand") + c("r_sand")
    return {
        "total_binder": binder,
        "ggbfs_fraction": c("ggbfs") / (binder + F.lit(eps)),
        "total_activator": c("na2sio3") + c("naoh"),
        "w_b_ratio": c("water") / (binder + F.lit(eps)),
        "total_aggregate": aggregate,
        "rca_fraction": c("rca") / (aggregate + F.lit(eps)),
        "r_sand_fraction": c("r_sand") / (aggregate + F.lit(eps)),
        "nca_fraction": c("nca") / (aggregate + F.lit(eps)),
        "sand_fraction": c("sand") / (aggregate + F.lit(eps)),
    }


def with_derived(df: DataFrame, eps: float = EPS) -> DataFrame:
    return df.withColumns(derived_columns(eps))


def feature_set_columns(df_columns: list[str], mode: str) -> list[str]:
    """raw(15) / engineered(12) / both (ordered union, 21). Unknown mode raises."""
    raw = [c for c in RAW_FEATURES if c in df_columns]
    if mode == "raw":
        return raw
    if mode in ("engineered", "engineered_12"):
        return list(ENGINEERED_12)
    if mode == "both":
        return list(dict.fromkeys(raw + ENGINEERED_12))
    raise ValueError(f"unknown feature mode {mode!r}")


def engineer(df: DataFrame, mode: str = "engineered", target: str | None = None,
             keep: tuple[str, ...] = ("row_id",), eps: float = EPS) -> DataFrame:
    """Project ``df`` to a feature set (plus key columns and the target when present)."""
    cols = feature_set_columns(df.columns, mode)
    need_derived = any(c in DERIVED for c in cols)
    base = with_derived(df, eps) if need_derived else df
    cols = [c for c in cols if c != target]
    out = [k for k in keep if k in df.columns] + cols
    if target is not None and target in df.columns:
        out.append(target)
    return base.select(*out)


def prune(df: DataFrame, drop: list[str]) -> DataFrame:
    """Drop columns when present (engineered_12 -> engineered_9)."""
    return df.drop(*[c for c in drop if c in df.columns])


def serve_columns(kind: str, eps: float = EPS) -> dict[str, Column]:
    """The 9 serving features of an app as named Columns over raw request columns."""
    c = F.col
    binder = c("flyash") + c("ggbfs")
    common = {
        "total_binder": binder,
        "ggbfs_fraction": c("ggbfs") / (binder + F.lit(eps)),
        "total_activator": c("na2sio3") + c("naoh"),
    }
    if kind == "strength":
        return {**common, "na2sio3_naoh_ratio": c("na2sio3") / (c("naoh") + F.lit(eps)),
                "naoh_molarity": c("naoh_molarity"), "w_b_ratio": c("water") / (binder + F.lit(eps)),
                "curing_temp_c": c("curing_temp_c"), "curing_time_hr": c("curing_time_hr"), "sp": c("sp")}
    aggregate = c("nca") + c("rca") + c("sand") + c("r_sand")
    return {**common, "naoh_molarity": c("naoh_molarity"), "activator_binder_ratio": c("activator_binder_ratio"),
            "w_b_ratio": c("water") / (binder + F.lit(eps)), "rca_fraction": c("rca") / (aggregate + F.lit(eps)),
            "curing_time_hr": c("curing_time_hr"), "sp": c("sp")}


def serve_features_strength(df: DataFrame, eps: float = EPS) -> DataFrame:
    """The strength app's 9 columns; the activator ratio is *derived* here (a
    train/serve skew the study carries: training uses the input column)."""
    c = F.col
    binder = c("flyash") + c("ggbfs")
    return df.select(
        *[k for k in ("row_id",) if k in df.columns],
        binder.alias("total_binder"),
        (c("ggbfs") / (binder + F.lit(eps))).alias("ggbfs_fraction"),
        (c("na2sio3") + c("naoh")).alias("total_activator"),
        (c("na2sio3") / (c("naoh") + F.lit(eps))).alias("na2sio3_naoh_ratio"),
        c("naoh_molarity"),
        (c("water") / (binder + F.lit(eps))).alias("w_b_ratio"),
        c("curing_temp_c"), c("curing_time_hr"), c("sp"),
    )


def serve_features_slump(df: DataFrame, eps: float = EPS) -> DataFrame:
    """The slump app's 9 columns (uses the input activator_binder_ratio)."""
    c = F.col
    binder = c("flyash") + c("ggbfs")
    aggregate = c("nca") + c("rca") + c("sand") + c("r_sand")
    return df.select(
        *[k for k in ("row_id",) if k in df.columns],
        binder.alias("total_binder"),
        (c("ggbfs") / (binder + F.lit(eps))).alias("ggbfs_fraction"),
        (c("na2sio3") + c("naoh")).alias("total_activator"),
        c("naoh_molarity"), c("activator_binder_ratio"),
        (c("water") / (binder + F.lit(eps))).alias("w_b_ratio"),
        (c("rca") / (aggregate + F.lit(eps))).alias("rca_fraction"),
        c("curing_time_hr"), c("sp"),
    )


def poly_terms(names: list[str], degree: int, interaction_only: bool) -> list[tuple[str, ...]]:
    """Monomials of degree 1..degree in the order sklearn's PolynomialFeatures emits them."""
    terms: list[tuple[str, ...]] = []
    comb = combinations if interaction_only else combinations_with_replacement
    for d in range(1, degree + 1):
        terms.extend(comb(names, d))
    return terms


def poly_columns(names: list[str], degree: int, interaction_only: bool) -> list[Column]:
    """Generated product expressions (no bias column)."""
    out = []
    for t in poly_terms(names, degree, interaction_only):
        expr = F.col(t[0])
        for n in t[1:]:
            expr = expr * F.col(n)
        out.append(expr.alias("__".join(t)))
    return out
