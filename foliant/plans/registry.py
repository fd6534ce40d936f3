"""Everything ``__spark_entry__`` publishes."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import foliant.plans as plans
from foliant.plans.world import CHECKS, PLANS, World


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if module.startswith("q_"):
            importlib.import_module(f"foliant.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bound(plan):
        return lambda spark, sf_dir: plan(World(spark, sf_dir))

    return {name: bound(PLANS[name]) for name in sorted(PLANS)}


def checks() -> dict[str, str]:
    _load()
    return {name: CHECKS[name] for name in sorted(CHECKS)}
