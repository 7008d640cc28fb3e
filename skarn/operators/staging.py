"""Tables that are used more than once, written to the folder all executors share and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on a local master, where no shared folder need be named.
LOCAL_FOLDER = "file:///tmp/checkpoints/skarn"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; LOCAL_FOLDER on a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_FOLDER).rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df, computed once: what follows reads Parquet, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skarn-staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm.org.apache.hadoop.fs.Path(path))
    return spark.read.schema(df.schema).parquet(path)
