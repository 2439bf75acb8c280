"""Registered queries and their reference SQL."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slabwise.plans import frontdoor  # noqa: F401  registers its queries
from slabwise.plans.queries import ORACLES as _SQL
from slabwise.plans.queries import QUERIES as _CORE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(_CORE)
ORACLES: dict[str, str] = dict(_SQL)


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the executors' Python path, once per application. Local masters
    share the driver's path and need nothing."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_slabwise_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="slabwise_zip_"), "slabwise_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("slabwise", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._slabwise_shipped = True
