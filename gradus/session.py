"""Making this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch; Spark's default of 10,000 texts takes tens of megabytes in each worker and executor.
BATCH_ROWS = "2048"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it, and keep their batches small.

    Where executors have the package installed only the size of batches
    changes, and that only if the session has Spark's default.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; unset, one of our own in local mode (tests), and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _FALLBACK.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="gradus-"))
    return root.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and a lost executor costs later jobs nothing."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
