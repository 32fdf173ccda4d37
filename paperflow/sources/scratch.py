"""Intermediate tables in the folder that all executors share.

A plan that reads one thing twice, and needs to see the same rows both times, reads a written table: Spark may evaluate a branch
anew, and rows that a range exchange has dealt out once need not be dealt out alike again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder of our own if the executors are threads of this process (tests);
    on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-paperflow-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/paperflow/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again. Its place is in the attribute scratch_path, for dropped()."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
