"""The package's code on the executors, wherever the driver was started from."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="factweave-code-"), "factweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(ROOT):
            for name in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(ROOT)))
    context.addPyFile(path)
    _sent.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after its code has been sent."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
