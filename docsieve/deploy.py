"""Ships the package to the executors, whose machines need not have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Most rows and bytes of a batch that goes to Python: a task holds several copies of one, on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the session's context, once an application; batches for Python are kept small in the session."""
    sc = spark.sparkContext
    for name, most in BATCH.items():
        now = str(spark.conf.get(name)).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)
    if sc.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    tmp = tempfile.mkdtemp(prefix="docsieve-")  # executors fetch the zip from the driver when their first task needs it
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    copy = os.path.join(tmp, "in", os.path.basename(home))
    shutil.copytree(home, copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(tmp, os.path.basename(home)), "zip", os.path.dirname(copy)))
    _shipped.add(sc.applicationId)
