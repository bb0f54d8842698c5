"""Session settings that suit both a laptop and a large cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app_name: str = "lodespark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE, skew handling and UTC; sizes stay with the cluster unless given."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives every executor this package, once for each application; needed wherever it is not installed on them."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    # the driver's file server hands the archive out for as long as the application runs
    tmp = os.path.realpath(tempfile.mkdtemp(prefix="lodespark-"))
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    at = f"{tmp}/lodespark-{app}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


#: Bytes of an Arrow batch. A batch exists in the JVM and in a Python worker, often with as much again in results, for each core.
BATCH_BYTES = "8m"


def prepare(spark: SparkSession) -> None:
    """What queries with Python stages need of a session: this package on the executors, and Arrow batches bounded by bytes unless the user has set them."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, BATCH_BYTES) == BATCH_BYTES:  # what is given counts only where the user has set nothing
        spark.conf.set(key, BATCH_BYTES)
