"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch that goes to a Python worker; Spark's own 64 MB times tasks times copies is more than workers have.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers started on this machine import the package wherever the driver was started (clusters: --py-files),
    and bounds the bytes of Arrow batches unless the session's own configuration says otherwise."""
    if not spark.sparkContext.getConf().contains(BATCH[0]):
        spark.conf.set(BATCH[0], str(BATCH[1]))
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark
