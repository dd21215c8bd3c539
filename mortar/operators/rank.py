"""Exact global ranks without an unpartitioned window.

``row_number() OVER (ORDER BY k)`` with no ``PARTITION BY`` runs in one task. Here the
order key is first cut into buckets that are monotone in the key (hash prefix, or
quantile ranges of a numeric key); a tiny per-bucket count table gives each bucket its
offset; the rank is the offset plus a row number *within* the bucket. The count table has
at most ``#partition keys x #buckets`` rows; it is joined by the keys that the window needs anyway, as
Spark's estimates may take the rows for the smaller side and broadcast them.
Work is spread over all buckets; the result equals the global row number.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mortar.session import row_side

DEFAULT_BUCKET_BITS = 12  # 4096 buckets


def exact_row_number(df: DataFrame, order_by: list[Column], bucket: Column,
                     partition_by: list[str] | tuple[str, ...] = (), out: str = "rn",
                     total_col: str | None = None) -> DataFrame:
    """Add a 0-based row number ``out`` within ``partition_by`` ordered by ``order_by``.

    ``bucket`` must be non-decreasing along ``order_by`` inside each partition. When
    ``total_col`` is given, the partition's row count is added too (needed by ntile).
    """
    parts = list(partition_by)
    b = df.withColumn("__bkt", bucket)
    counts = b.groupBy(*parts, "__bkt").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*parts).orderBy("__bkt")
    offsets = counts.withColumn(
        "__off", F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    if total_col:
        offsets = offsets.withColumn(total_col, F.sum("__cnt").over(Window.partitionBy(*parts)))
    offsets = offsets.drop("__cnt")
    joined = b.join(row_side(offsets), on=[*parts, "__bkt"], how="inner")
    wb = Window.partitionBy(*parts, "__bkt").orderBy(*order_by)
    return joined.withColumn(out, F.col("__off") + F.row_number().over(wb) - 1).drop("__bkt", "__off")


def with_quantile_bucket(df: DataFrame, col: str, n_buckets: int = 1 << DEFAULT_BUCKET_BITS,
                         rel_err: float = 1e-3) -> DataFrame:
    """``df`` with ``__bkt``, the approximate quantile range of ``col`` (non-decreasing in it)."""
    qs = df.approxQuantile(col, [i / n_buckets for i in range(1, n_buckets)], rel_err)
    full = [float("-inf"), *sorted({float(q) for q in qs if q is not None}), float("inf")]
    if len(full) < 3:
        return df.withColumn("__bkt", F.lit(0).cast("long"))
    tmp = df.withColumn("__qx", F.col(col).cast("double"))
    tmp = Bucketizer(splits=full, inputCol="__qx", outputCol="__qb", handleInvalid="keep").transform(tmp)
    return tmp.withColumn("__bkt", F.col("__qb").cast("long")).drop("__qx", "__qb")


def rank_by_numeric(df: DataFrame, col: str, partition_by: list[str] | tuple[str, ...] = (),
                    out: str = "rn", descending: bool = False, total_col: str | None = None,
                    n_buckets: int = 1 << DEFAULT_BUCKET_BITS, rel_err: float = 1e-3) -> DataFrame:
    """Exact 0-based rank by a numeric, unique-within-partition column.

    Bucket boundaries are approximate quantiles of ``col`` (only ``n_buckets`` numbers
    reach the driver); MLlib's Bucketizer places each row by a JVM binary search. The
    quantiles only balance the buckets; the rank itself is exact.
    """
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.approxQuantile(col, probs, rel_err)
    splits = sorted(set(float(q) for q in qs if q is not None))
    full = [float("-inf"), *(splits or [0.0]), float("inf")]  # an empty table has no quantiles
    tmp = df.withColumn("__qx", F.col(col).cast("double"))
    tmp = Bucketizer(splits=full, inputCol="__qx", outputCol="__qb", handleInvalid="keep").transform(tmp)
    bucket = F.col("__qb").cast("long")
    order = [F.col(col).desc()] if descending else [F.col(col).asc()]
    if descending:
        bucket = F.lit(len(full)) - bucket
    ranked = exact_row_number(tmp, order, bucket, partition_by, out=out, total_col=total_col)
    return ranked.drop("__qx", "__qb")


def assign_by_rank(df: DataFrame, order_by: list[Column], bucket: Column, partition_by: list[str] | tuple[str, ...],
                   rank_fn, out: str) -> DataFrame:
    """``out = rank_fn(rank, n)`` for a step function of the exact rank, ranking only where needed.

    ``rank_fn`` must be monotone in the rank (fold = ntile, val = rank < n_val, ...). A
    bucket whose first and last rank map to the same value is decided from its offset
    alone; only rows of the few buckets that straddle a step (at most one per step and
    partition key) are ranked exactly by a window. No sort of the whole table.
    ``partition_by``: a few keys, as folds are; their buckets' table is broadcast.
    """
    parts = list(partition_by)
    b = df.withColumn("__bkt", bucket)
    counts = b.groupBy(*parts, "__bkt").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*parts).orderBy("__bkt")
    off = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                                F.lit(0)))
    off = off.withColumn("__n", F.sum("__cnt").over(Window.partitionBy(*parts)))
    first = rank_fn(F.col("__off"), F.col("__n"))
    last = rank_fn(F.col("__off") + F.col("__cnt") - 1, F.col("__n"))
    off = off.select(*parts, "__bkt", "__off", "__n", first.alias("__v"), (first == last).alias("__clean"))
    j = b.join(F.broadcast(off), on=[*parts, "__bkt"], how="inner")
    clean = j.where(F.col("__clean")).withColumn(out, F.col("__v"))
    dirty = j.where(~F.col("__clean"))
    wb = Window.partitionBy(*parts, "__bkt").orderBy(*order_by)
    dirty = dirty.withColumn(out, rank_fn(F.col("__off") + F.row_number().over(wb) - 1, F.col("__n")))
    return clean.unionByName(dirty).drop("__bkt", "__off", "__n", "__v", "__clean")
