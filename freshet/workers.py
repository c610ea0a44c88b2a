"""Python workers and this package."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_given: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of the session, once: they may start where it cannot be imported."""
    context = spark.sparkContext
    if context.applicationId in _given:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="freshet-code-"))
    copied = shutil.copytree(
        package, os.path.join(folder, "code", "freshet"), ignore=shutil.ignore_patterns("__pycache__")
    )
    context.addPyFile(shutil.make_archive(os.path.join(folder, "freshet"), "zip", os.path.dirname(copied)))
    _given.add(context.applicationId)
