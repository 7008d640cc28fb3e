"""A local Spark session for tests, the bench and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", 8))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("skarn")
    settings = {
        "spark.sql.shuffle.partitions": str(cpus), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("SKARN_DRIVER_MEMORY", "8g"),
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
