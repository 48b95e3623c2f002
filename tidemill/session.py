"""What a session needs besides Spark: this package's code on its executors, and a folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT = "spark.checkpoint.dir"
#: Bytes of rows that an executor hands to Python at once, unless the session says otherwise: Spark's 64 MB are held several
#: times over, outside the heap and in the worker, by each of an executor's tasks.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on a local master may go without it (tests); a cluster
    without the setting is an error, since a machine-local folder would lose data.
    """
    base = spark.conf.get(CHECKPOINT, None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"{CHECKPOINT} must name a folder that all executors share")
    base = tempfile.mkdtemp(prefix="tidemill-")
    spark.conf.set(CHECKPOINT, base)
    return base


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application (Spark's file server distributes it), and keep batches for Python small."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemill-code-"), "tidemill_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for x in sorted(names):
                if x.endswith(".py"):
                    full = os.path.join(folder, x)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
