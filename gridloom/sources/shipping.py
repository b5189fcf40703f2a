"""Sending this package to the executors, which need it where columns pass through Python."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import gridloom

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; Spark's file server hands the archive to every executor that joins, also later."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(gridloom.__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), "gridloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
