"""Makes the package importable in Python workers that have neither its path nor its folder."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    here = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if os.path.realpath(ROOT) in [*here, os.path.realpath(os.getcwd())] or getattr(spark.sparkContext, "_quire_core", False):
        return
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="quire-zip-"), "quire_core"), "zip", ROOT, "quire"))
    spark.sparkContext._quire_core = True
