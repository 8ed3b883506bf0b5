"""Python workers must find this package wherever the driver imported it from."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> SparkSession:
    """Adds the package's folder to the path of Python workers started for this session. On a
    cluster whose machines have the package installed (or get it by --py-files) it changes
    nothing: a folder that is not there is passed over."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark
