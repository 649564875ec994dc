"""Lets Python workers import this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PACKAGE = __name__.split(".", 1)[0]
_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Puts the package on the workers' path: by its folder, and on a cluster also as an archive that Spark hands to every executor."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    context = spark.sparkContext
    if ROOT not in context.environment.get("PYTHONPATH", "").split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, context.environment.get("PYTHONPATH", "")) if x)
    if context.master.split("[")[0] != "local" and context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        here = tempfile.mkdtemp()  # on the driver, which serves the file to executors as long as it runs
        atexit.register(shutil.rmtree, here, True)
        context.addPyFile(shutil.make_archive(os.path.join(here, PACKAGE), "zip", ROOT, PACKAGE))
