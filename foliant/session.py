"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "foliant", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. Cluster sizing stays with the caller."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


MEMORY_PER_FILE_BYTE = 10.0  # what a byte of a compressed columnar file takes as rows: 9 to 20 bytes a row in files, some 100 and more in memory


def count_rows_in_memory(spark: SparkSession) -> None:
    """Have the planner judge a table by what its rows take in memory; a factor the caller chose stays.

    By the size of compressed files, tables of a million rows pass for small ones, and each join that broadcasts
    one gathers it in the driver.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) == 1.0:
        spark.conf.set(name, str(MEMORY_PER_FILE_BYTE))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names; a folder of the warehouse where none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there.

    A lost executor re-reads the written blocks, so iterative jobs survive it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage: Spark deletes the shuffle files of a finished step when its plan is collected.

    A driver with memory to spare doesn't collect for long, and executors keep the files of all steps. The first round
    lets go of what still refers to the plan, the second one finds it unused; both take some tenths of a second.
    """
    for _ in range(2):
        time.sleep(0.1)
        spark.sparkContext._jvm.java.lang.System.gc()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and continue from there.

    For snapshots that many further steps build on. A checkpoint takes over the size estimate of its plan, a
    product over all joined tables, which grows from step to step until planning takes longer than the work;
    a written table's size is known, and it takes a fraction of the disk of a checkpoint's rows.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Apply ``step`` until ``changed(old, new)`` is empty, checkpointing every round.

    For steps that are known to settle; there is no limit on the rounds.
    """
    while True:
        following = materialize(step(state))
        if not changed(state, following).head(1):
            return following
        state = following


def join_sparse(df: DataFrame, other: DataFrame, key: str, spread_by: str, how: str = "left") -> DataFrame:
    """Left or anti join on a string column that is null for most rows.

    Nulls can't match, so they take a value of their own made from ``spread_by`` instead of meeting in one task.
    """
    probe = F.coalesce(df[key], F.concat(F.lit("\x00"), df[spread_by].cast("string")))
    right = other.select(F.col(key).alias("_key"), *[c for c in other.columns if c != key])
    joined = df.join(right, probe == F.col("_key"), how)
    return joined if how == "left_anti" else joined.drop("_key")


def salted(df: DataFrame, buckets: int, column: str = "_salt", *by: str) -> DataFrame:
    """Add a deterministic salt from the ``by`` columns, for two-step work on hot keys."""
    return df.withColumn(column, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
