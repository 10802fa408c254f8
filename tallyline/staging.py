"""Written intermediate tables.

``stage`` writes a table once as Parquet below the shared folder named by
``spark.checkpoint.dir`` and reads it back.  It cuts lineage, survives the loss
of executors, and lets several branches of a plan scan only the columns they use.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: tempfile.TemporaryDirectory | None = None


def shared_root(spark: SparkSession) -> str:
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_root is None:
        _local_root = tempfile.TemporaryDirectory(prefix="tallyline-")
    return _local_root.name


def session_folder(spark: SparkSession) -> str:
    """All staged tables of this application lie below one folder."""
    return f"{shared_root(spark)}/tallyline/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete this application's staged tables; results must be stored or read by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
