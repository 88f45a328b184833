"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder for a local master, as in tests, and an error on a cluster."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark.sparkContext, "_scriptoria_own", None) or "file://" + tempfile.mkdtemp(prefix="scriptoria-")
        spark.sparkContext._scriptoria_own = path
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/scriptoria/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
