"""Puts the library within reach of Python workers that were not started with it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package through Spark's own file server, once an application, unless workers inherit a path to it."""
    inherited = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if app in _sent or ROOT in (*inherited, os.getcwd()):
        return
    folder = tempfile.mkdtemp()  # the driver's file server reads it until the application ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "graphloom"), "zip", ROOT, "graphloom"))
    _sent.add(app)
