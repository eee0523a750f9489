"""Send this package to the Python workers, for sessions that were not started with it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: what ``spark-submit --py-files`` would do. Spark serves the archive to the executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    base = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="scorewell-")), "scorewell")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "scorewell"))
    _shipped.add(app)
