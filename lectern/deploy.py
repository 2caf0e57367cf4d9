"""Shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Most bytes of a batch that Spark hands to a Python worker.
BATCH = "4m"


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that do not share the driver's folders, and bound by bytes the batches that go to Python workers; once a session."""
    if not getattr(spark, "_lectern_batches", False):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        spark._lectern_batches = True
    context = spark.sparkContext
    if getattr(context, "_lectern_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="lectern-"), "lectern.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    context._lectern_shipped = True
