"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder is
    made, which is right in local mode only; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    # with its scheme, so that Spark and other readers mean the same place
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    own = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return own.makeQualified(path).toString().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage, and a lost
    executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str, per_task: int = 500_000) -> DataFrame:
    """``df`` dealt by ``keys`` over a number of tasks that follows its count of rows, so that what a task sorts
    or holds doesn't grow with the table (a partition that is merged by its compressed bytes would)."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)), *keys)
