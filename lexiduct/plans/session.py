"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver found it.  On a
    cluster without that folder, install the package or ship it with addPyFile.

    Also bounds the Arrow batches that workers get by bytes, where the session hasn't
    changed Spark's own bound: rows hold whole texts, and long ones gather in some batches."""
    if spark.conf.get(ARROW_BYTES) == "67108864b":
        spark.conf.set(ARROW_BYTES, "8m")
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = f"{have}{os.pathsep}{ROOT}" if have else ROOT
    return spark
