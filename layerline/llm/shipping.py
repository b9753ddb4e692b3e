"""Makes the package importable in Python workers, as ``spark-submit --py-files`` would."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import layerline


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_layerline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(layerline.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="layerline-"), "layerline.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("layerline", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._layerline_shipped = True
