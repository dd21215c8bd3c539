"""Scans of the driver tables and the canonical ``mix`` view.

``mix`` re-expresses a clean mix-design table over ``orders`` (one row per order, so
``row_id`` is unique). Recipe columns depend only on ``o_custkey`` (a customer is a mix
design, so strict groups hold several rows); curing and aggregate columns vary per row.
Only the columns the view needs are read, so the parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = "compressive_strength_mpa"
SLUMP_TARGET = "slump_mm"

# The 15 raw feature columns in the reference's canonical order.
RAW_FEATURES = [
    "flyash", "ggbfs", "curing_temp_c", "curing_time_hr", "na2sio3", "naoh",
    "na2sio3_naoh_ratio", "naoh_molarity", "activator_binder_ratio", "water", "sp",
    "nca", "rca", "sand", "r_sand",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(c: Column) -> Column:
    return c.cast("double")


def mix_columns(orderkey: Column, custkey: Column, totalprice: Column) -> list[Column]:
    """The mix projection as Column expressions (shared by the batch and streaming paths)."""
    ok, ck = orderkey, custkey
    target = F.when(ok % 17 == 0, F.lit(None).cast("double")).otherwise(
        F.lit(20.0) + _d((ck % 26) * 20) / F.lit(20.0) + _d((ok % 6) * 3) - _d(ok % 13)
        + totalprice / F.lit(100000.0)
    )
    return [
        ok.cast("long").alias("row_id"),
        _d((ck % 34) * 20).alias("flyash"),
        _d((ck % 26) * 20).alias("ggbfs"),
        _d(F.lit(20) + (ok % 6) * 20).alias("curing_temp_c"),
        _d((ok % 3) * 24).alias("curing_time_hr"),
        _d((ck % 14) * 20).alias("na2sio3"),
        _d((ck % 12) * 20).alias("naoh"),
        (_d(ck % 14) / _d(F.lit(1) + ck % 12)).alias("na2sio3_naoh_ratio"),
        _d(F.lit(8) + (ck % 5) * 2).alias("naoh_molarity"),
        (_d(ck % 9) / F.lit(8.0)).alias("activator_binder_ratio"),
        _d((ok % 13) * 10).alias("water"),
        _d(ok % 25).alias("sp"),
        _d((ok % 17) * 100).alias("nca"),
        _d((ok % 11) * 100).alias("rca"),
        _d((ok % 9) * 100).alias("sand"),
        _d((ok % 7) * 75).alias("r_sand"),
        target.alias(TARGET),
    ]


def mix_from_orders(orders: DataFrame) -> DataFrame:
    return orders.select(*mix_columns(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")))


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical mix table (FIXTURES F1b): row_id + 15 features + nullable target."""
    return mix_from_orders(table(spark, sf_dir, "orders"))


def mix_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix rows with a known target (the study's training population)."""
    return mix(spark, sf_dir).where(F.col(TARGET).isNotNull())


# The same view as DuckDB SQL (used by the oracle strings only).
MIX_SQL = """SELECT o_orderkey AS row_id,
 CAST((o_custkey % 34) * 20 AS DOUBLE) AS flyash,
 CAST((o_custkey % 26) * 20 AS DOUBLE) AS ggbfs,
 CAST(20 + (o_orderkey % 6) * 20 AS DOUBLE) AS curing_temp_c,
 CAST((o_orderkey % 3) * 24 AS DOUBLE) AS curing_time_hr,
 CAST((o_custkey % 14) * 20 AS DOUBLE) AS na2sio3,
 CAST((o_custkey % 12) * 20 AS DOUBLE) AS naoh,
 CAST((o_custkey % 14) AS DOUBLE) / CAST(1 + o_custkey % 12 AS DOUBLE) AS na2sio3_naoh_ratio,
 CAST(8 + (o_custkey % 5) * 2 AS DOUBLE) AS naoh_molarity,
 CAST(o_custkey % 9 AS DOUBLE) / CAST(8 AS DOUBLE) AS activator_binder_ratio,
 CAST((o_orderkey % 13) * 10 AS DOUBLE) AS water,
 CAST(o_orderkey % 25 AS DOUBLE) AS sp,
 CAST((o_orderkey % 17) * 100 AS DOUBLE) AS nca,
 CAST((o_orderkey % 11) * 100 AS DOUBLE) AS rca,
 CAST((o_orderkey % 9) * 100 AS DOUBLE) AS sand,
 CAST((o_orderkey % 7) * 75 AS DOUBLE) AS r_sand,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE
   CAST(20 AS DOUBLE) + CAST((o_custkey % 26) * 20 AS DOUBLE) / CAST(20 AS DOUBLE)
   + CAST((o_orderkey % 6) * 3 AS DOUBLE) - CAST((o_orderkey % 13) AS DOUBLE)
   + o_totalprice / CAST(100000 AS DOUBLE) END AS compressive_strength_mpa
FROM orders"""
