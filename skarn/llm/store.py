"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import sys
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on a local master, where no shared folder need be named.
LOCAL_FOLDER = "file:///tmp/checkpoints/skarn"

#: Files that a gathered table has for each core of the cluster.
FILES_A_CORE = 4

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; LOCAL_FOLDER on a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_FOLDER).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/skarn-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: a lineage cut that outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """df in FILES_A_CORE partitions for each core at most, whose shuffle partitions a task takes one after the other.

    For tables of short rows: without Hadoop's native library a file that is written to a local folder makes the executor launch
    processes to set permissions, however few rows the file has.
    """
    return df.coalesce(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


def prefix(df: DataFrame) -> str:
    """A beginning of helper columns' names that no column of df has."""
    out = "_skarn"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def least_hashes(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most so many rows of df, those with the least hash of key; ties by all columns.

    A threshold on the hash leaves half as many again at first, so that few rows are sorted at any size of df.
    """
    total = max(1, df.count())
    share, h = min(1.0, (1.5 * rows + 100) / total), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    return df.where(h < int(share * (1 << 40))).orderBy(h, *df.columns).limit(rows)


def trim() -> None:
    """Give back what a Python worker no longer uses; workers stay, and others' tasks need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library from the driver's path, if it isn't installed on them."""
    root = str(Path(__file__).resolve().parents[2])
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep) and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception as error:  # the session may be gone already
            print(f"left behind: {path} ({type(error).__name__})", file=sys.stderr)
            return
