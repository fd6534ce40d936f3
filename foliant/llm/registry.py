"""The queries of this package and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

import foliant.llm as package
from foliant.llm.common import CHECKS, QUERIES


def load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
        importlib.import_module(f"foliant.llm.{module}")


def queries():
    load()
    return dict(sorted(QUERIES.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def checks():
    load()
    return dict(CHECKS)
