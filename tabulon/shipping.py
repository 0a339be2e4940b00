"""The package's code on every executor, wherever the session runs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip to the session's files, once for each application; Python workers import it from there."""
    app = spark.sparkContext.applicationId
    if app not in _DONE:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tabulon-code-"), "tabulon.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(here)))
        spark.sparkContext.addPyFile(path)
        _DONE.add(app)
    return spark
