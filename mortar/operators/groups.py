"""Leakage groups.

A group is a set of rows sharing a base mix design. Keys are built as integers
(``bround(x * 10^dp)`` = NumPy's multiply-then-rint rounding, half-even) so equality never
goes through double->string formatting. Group codes follow first appearance, i.e. the
rank of each group's smallest ``row_id``; the rank is exact and fully parallel
(:mod:`mortar.operators.rank`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mortar.operators.rank import rank_by_numeric

# Default strict key (binder + activator chemistry) and the relaxed key.
STRICT_KEYS = ["flyash", "ggbfs", "na2sio3", "naoh", "naoh_molarity", "activator_binder_ratio"]
RELAXED_KEYS = ["flyash", "ggbfs", "na2sio3_naoh_ratio"]


def _key_cols(df: DataFrame, cols: list[str], decimals: int) -> list:
    scale = float(10 ** decimals)
    return [F.bround(F.col(c).cast("double") * F.lit(scale), 0).cast("long").alias(f"__k{i}")
            for i, c in enumerate(cols)]


def assign_groups(df: DataFrame, key_cols: list[str] | None = None, decimals: int = 3,
                  id_col: str = "row_id", out: str = "group_id") -> DataFrame:
    """Add ``group_id`` (0-based, by first appearance) for the rounded key.

    Missing default key columns are ignored; with no key column at all every row is its
    own group (D2's identity rule).
    """
    if key_cols is None:
        key_cols = STRICT_KEYS
    cols = [c for c in key_cols if c in df.columns]
    if not cols:
        ranked = rank_by_numeric(df.select(id_col), id_col, out=out)
        return df.join(ranked, id_col)
    keyed = df.select("*", *_key_cols(df, cols, decimals))
    knames = [f"__k{i}" for i in range(len(cols))]
    firsts = keyed.groupBy(*knames).agg(F.min(id_col).alias("__first"))
    coded = rank_by_numeric(firsts, "__first", out=out).drop("__first")
    # groups <= rows; the join is left to AQE (broadcast when the runtime size is small,
    # skew-split when one design holds a large share of rows)
    return keyed.join(coded, on=knames, how="inner").drop(*knames)


def assign_groups_relaxed(df: DataFrame, id_col: str = "row_id", out: str = "group_id") -> DataFrame:
    """Relaxed key (flyash, ggbfs, na2sio3_naoh_ratio) at 2 decimals."""
    return assign_groups(df, RELAXED_KEYS, decimals=2, id_col=id_col, out=out)


def group_sizes(grouped: DataFrame, top: int | None = 10) -> DataFrame:
    """D3: rows per group, largest first (ties: lower code first)."""
    out = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_rows"))
    out = out.orderBy(F.col("n_rows").desc(), F.col("group_id").asc())
    return out.limit(top) if top else out


def group_summary(grouped: DataFrame) -> DataFrame:
    """Number of rows and groups, mean/median/max group size, singleton groups."""
    sizes = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        F.avg("n").alias("mean_size"),
        F.median("n").cast("double").alias("median_size"),
        F.max("n").cast("long").alias("max_size"),
        F.count_if(F.col("n") == 1).cast("long").alias("n_singletons"),
    )


def group_size_histogram(grouped: DataFrame) -> DataFrame:
    """how many groups have each size."""
    sizes = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"))
