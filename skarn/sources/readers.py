"""Readers: CSV, Parquet files and folders, images, fitted models, YAML."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, na_values: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header. Without a schema the types are inferred. na_values: further texts that mean null."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)] if na_values else []
    return df.withColumns({c: F.when(~F.coalesce(F.col(c).isin(*na_values), F.lit(False)), F.col(c)) for c in texts})


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By the path's ending: .csv, .parquet, .pq, or a folder of Parquet. FileNotFoundError if it isn't there, ValueError for others."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, path, schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if suffix in (".parquet", ".pq") or at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    raise ValueError(f"no reader for {path}: .csv, .parquet, .pq or a folder of Parquet")


def load_dataset(spark: SparkSession, config: dict) -> DataFrame:
    """By config["source"]: synthetic (n_samples, churn_rate, seed) or csv (path)."""
    from skarn.operators.synthetic import churn

    source = config.get("source", "synthetic")
    if source == "synthetic":
        return churn(spark, int(config.get("n_samples", 5000)), float(config.get("churn_rate", 0.27)), int(config.get("seed", 42)))
    if source == "csv":
        return read_table(spark, config["path"])
    raise ValueError(f"unknown source {source!r}: synthetic or csv")


def load_model(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return PipelineModel.load(path)


def load_yaml(path: str) -> dict:
    """A mapping; FileNotFoundError if it isn't there, ValueError for anything else than a mapping."""
    import yaml

    with open(path) as file:
        value = yaml.safe_load(file)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def read_images(spark: SparkSession, path: str, size: int = 250) -> DataFrame:
    """path, label (0 if the file name starts with m, else 1), r, g, b: the mean of each channel, 0 to 1, over the image resized to size by size.

    Resizing is bilinear between the centres of pixels; grey images have three equal channels. Files that are no image are left out.
    """

    def means(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for height, width, channels, data in zip(frame["height"], frame["width"], frame["nChannels"], frame["data"], strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                rows, columns = _resizing(height, size), _resizing(width, size)
                mean = np.einsum("r,rck,c->k", rows, pixels.astype(np.float64), columns) / 255
                out.append(mean[2::-1] if channels >= 3 else np.repeat(mean[:1], 3))  # blue comes first
            rgb = np.array(out).reshape(-1, 3)
            yield pd.DataFrame({"path": frame["origin"], "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})

    df = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    name = F.element_at(F.split("path", "/"), -1)
    return df.mapInPandas(means, "path string, r double, g double, b double").select("path", F.when(name.startswith("m"), 0).otherwise(1).alias("label"), "r", "g", "b")


def _resizing(length: int, size: int) -> np.ndarray:
    """How much each of length pixels in a row adds to the mean of size pixels."""
    at = np.clip((np.arange(size) + 0.5) * length / size - 0.5, 0, length - 1)
    low = np.floor(at).astype(np.int64)
    share = np.bincount(low, 1 - (at - low), length) + np.bincount(np.minimum(low + 1, length - 1), at - low, length)
    return share / size
