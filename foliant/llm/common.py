"""Helpers that several corpus operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import foliant
from foliant.session import ensure_checkpoint_dir

# Executors need not have this package installed: task functions travel with the job.
cloudpickle.register_pickle_by_value(foliant)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and, where there is one, its SQL."""
    def register(plan):
        QUERIES[name] = plan
        if check is not None:
            CHECKS[name] = check
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    This cuts lineage like a reliable checkpoint, but columns can be pruned on reading.
    A lost executor costs only a re-read.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_process(key, build: Callable):
    """``build()`` once in each Python worker: vocabularies and tables outlive a task."""
    store = sys.modules.setdefault("_foliant_worker_cache", types.ModuleType("_foliant_worker_cache")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]
