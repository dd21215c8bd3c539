"""Result sinks and side tables (A2-A9): named-table sinks, replace-on-write, manifests,
legacy positional imports, study merging and upserts. Everything goes through Spark's
writers/readers on the shared file system (no single-machine workbook format).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET_NAME_MAX = 31


def write_tables(tables: dict[str, DataFrame], out: str) -> None:
    """A4: one folder per named table (``out/<name>``), overwrite."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def read_tables(spark: SparkSession, out: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{out}/{n}") for n in names}


def write_sheets_partitioned(df: DataFrame, out: str, replace: bool) -> None:
    """A5: append sheets; with ``replace`` a sheet present in ``df`` replaces the stored one
    (dynamic partition overwrite on ``sheet``) and other sheets are kept."""
    w = df.write.partitionBy("sheet")
    if replace:
        w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        w = w.mode("append")
    w.parquet(out)


def sheet_name(prefix: str, name) -> F.Column:
    """Prefixed sheet names cut to 31 characters."""
    return F.substring(F.concat(F.lit(prefix), name), 1, SHEET_NAME_MAX)


def combine_studies(studies: dict[str, DataFrame]) -> DataFrame:
    """Union tables of several studies, tagging each row with its study."""
    tagged = [df.withColumn("study", F.lit(s)) for s, df in studies.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Replace values of matching keys; report which new rows found no target.

    Full outer join on ``keys``; ``status`` is ``updated`` / ``kept`` / ``NOT FOUND``
    (the reference reports unmatched rows instead of inserting them, so they are dropped
    from the table but listed)."""
    o = old.select(*keys, *[F.col(v).alias(f"__o_{v}") for v in values], F.lit(True).alias("__in_old"))
    n = new.select(*keys, *[F.col(v).alias(f"__n_{v}") for v in values], F.lit(True).alias("__in_new"))
    j = o.join(n, keys, "full_outer")
    status = (F.when(F.col("__in_old").isNull(), "NOT FOUND").when(F.col("__in_new").isNull(), "kept")
              .otherwise("updated"))
    return j.select(*keys, *[F.coalesce(F.col(f"__n_{v}"), F.col(f"__o_{v}")).alias(v) for v in values],
                    status.alias("status"))


def write_manifest(df: DataFrame, path: str) -> None:
    """A one-row nested manifest as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def merge_manifest(spark: SparkSession, path: str, key: str, value: DataFrame, out: str) -> DataFrame:
    """A6 merge: read, replace one top-level struct field, write to ``out`` (one row each)."""
    cur = spark.read.json(path)
    merged = cur.drop(key).crossJoin(value.select(F.struct(*value.columns).alias(key)))  # 1 x 1 rows
    write_manifest(merged, out)
    return spark.read.json(out)


def legacy_positional(raw: DataFrame, first: int = 2, last: int = 8) -> DataFrame:
    """A3: headerless two-header-row table; rows ``first..last`` by file position, model in
    column 0, R^2 at ordinals 4 / 12 / 20, derived gap."""
    idx = raw.withColumn("__pos", F.monotonically_increasing_id())  # one small file, file order
    rows = idx.where((F.col("__pos") >= first) & (F.col("__pos") <= last))
    num = lambda c: F.when(F.col(c).rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"),
                           F.trim(F.col(c)).try_cast("double"))
    out = rows.select(F.col("_c0").alias("model"), num("_c4").alias("train_r2_old"), num("_c12").alias("val_r2_old"),
                      num("_c20").alias("test_r2_old"))
    return out.withColumn("overfit_gap_old", F.col("train_r2_old") - F.col("test_r2_old"))
