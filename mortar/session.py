"""Session helpers: a local session for tests/bench and the shared scratch folder.

On a cluster the session is created by the platform; ``scratch_dir`` then reads the
shared ``spark.checkpoint.dir``; without that setting a cluster run fails, and only a local
master (tests, local runs) gets a folder of its own.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "mortar") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # broadcast threshold stays at Spark's default; explicit broadcasts in mortar are
        # always behind a size check (see operators.rank / operators.splits)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    local = tempfile.mkdtemp(prefix="mortar-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, by: str | None = "row_id", spread: bool = False):
    """Cut lineage by writing ``df`` to the shared checkpoint folder (reliable checkpoint).

    Used for tables that several later stages read (fold tables, group maps): they are
    computed once, survive executor loss, and later plans start from the written files.
    ``spread``: into two partitions a core at least, for narrow rows that much work follows on (by
    size alone the runtime plan would leave a few).
    The table is hash-partitioned by ``by`` (``row_id``) first; the checkpoint keeps that
    partitioning, so later joins on ``row_id`` shuffle only the (smaller) other side.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if by and by in df.columns:
        cores = df.sparkSession.sparkContext.defaultParallelism
        df = df.repartition(2 * cores, by) if spread else df.repartition(by)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Spark drops a query's shuffle files when the query ends, not when the driver's garbage is next collected.

    For several passes over a table whose results are collected or written; no frame may be run twice as it is."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def row_side(df):
    """A join side with a row for each data row, which must not be broadcast.

    Spark estimates it by the size of compressed files and sees neither their real size nor rows
    repeated by ``explode``, so it would send such a table through the driver."""
    return df.hint("merge")
