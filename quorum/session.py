"""A session with the settings that the operators assume."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, which else find it only where it is installed or in their folder."""
    folder = tempfile.mkdtemp(prefix="quorum-")  # the driver serves it to executors while the session lasts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "quorum.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    spark.sparkContext.addPyFile(path)
    return spark


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
    b = b.master(master) if master else b
    b = b.config("spark.sql.shuffle.partitions", str(partitions)) if partitions else b
    for k, v in conf.items():
        b = b.config(k, v)
    return ship(b.getOrCreate())
