"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that they need no install of it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir() and sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp())
    if not any("pricewright" in str(p) for p in sc._python_includes):
        root = os.path.dirname(os.path.abspath(__file__))
        at = os.path.join(tempfile.mkdtemp(), "pricewright.zip")
        with zipfile.ZipFile(at, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        sc.addPyFile(at)
    return spark


def scratch(spark: SparkSession, what: str) -> str:
    """A new place in the folder of ``spark.checkpoint.dir``, deleted when the application ends; where that is unset a local session gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp()}"
    at = f"{at.rstrip('/')}/pricewright-{what}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at
