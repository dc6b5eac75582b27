"""Python workers that see this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def put_package_on_path(spark: SparkSession) -> None:
    """For workers that see this package's folder. Elsewhere it must be installed or
    passed with --py-files, as any package."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
