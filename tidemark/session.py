"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def visible_to_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package from where the driver has it.

    On a cluster, pass the package with ``--py-files``; the entry then names a
    folder that executors don't have, which Python skips.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark
