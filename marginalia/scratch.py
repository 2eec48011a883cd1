"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; unset, a folder of this machine, which only a local session may use."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table it is written to: computed once, its lineage cut."""
    path = new_folder(df.sparkSession, "t")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
