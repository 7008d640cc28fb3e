"""Imputing, scaling, encoding and stratified splits, as statistics fitted by queries and applied as expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.columns import is_missing, numeric

from .ordered import quantiles, running

BUCKET_ROWS = 100_000  # of a shuffled order that one window holds


def _stacked(df: DataFrame, columns: list[str], as_text: bool) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    value = lambda c: F.when(~is_missing(F.col(c), kinds[c]), F.col(c).cast("string")) if as_text else numeric(F.col(c), kinds[c])
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), value(c).alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null")


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, median (exact, linear between the middle two)."""
    return quantiles(_stacked(df, columns, False), ["feature"], "value", [0.5]).select("feature", F.col("quantile").alias("median"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mode: the most frequent value as text, the least of several."""
    counts = _stacked(df, columns, True).groupBy("feature", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("mode"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, scale: population standard deviation, 1 where it is 0."""
    out = _stacked(df, columns, False).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.select("feature", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("scale"))


def vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, value, position (from 0, in the order of values) of every category."""
    found = _stacked(df, columns, True).groupBy("feature", "value").agg(F.lit(1).alias("one"))
    return found.select("feature", "value", (F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1).alias("position"))


def one_hot(fit: DataFrame, df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, feature, position of the ones in df's encoding; unknown and missing values have none."""
    kinds = {f.name: f.dataType for f in df.schema}
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.when(~is_missing(F.col(c), kinds[c]), F.col(c).cast("string")).alias("value")) for c in columns))
    long = df.select(key, F.explode(pairs).alias("x")).select(key, "x.*").where("value is not null")
    return long.join(vocabulary(fit, columns), ["feature", "value"]).select(key, "feature", "position")


def impute(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """df with missing values replaced; NaN counts as missing."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.when(is_missing(F.col(c), kinds[c]), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def scale(df: DataFrame, moments_of: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in moments_of.items()})


def features_and_target(df: DataFrame, target: str) -> tuple[list[str], DataFrame]:
    """The feature names, and df with the target as an int; KeyError without it."""
    if target not in df.columns:
        raise KeyError(target)
    return [c for c in df.columns if c != target], df.withColumn(target, F.col(target).cast("int"))


def shuffled_rank(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """df with rank (from 0) and total_rank inside each label, in the order of a hash of key: the base of exact splits."""
    text = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))) if seed else F.md5(F.col(key).cast("string"))
    buckets = max(1, -(-df.count() // BUCKET_ROWS))
    hashed = df.withColumn("_h", text).withColumn("_bucket", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
    return running(hashed, [label], [F.col("_h"), F.col(key)], {"rank": F.lit(1)}).drop("_h")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int = 0) -> DataFrame:
    """df with fold: 0 to folds - 1, every label spread evenly."""
    return shuffled_rank(df, label, key, seed).withColumn("fold", (F.col("rank") % folds).cast("int")).drop("rank", "total_rank")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float, seed: int = 0) -> DataFrame:
    """df with is_test: that share of every label, rounded to whole rows."""
    ranked = shuffled_rank(df, label, key, seed)
    return ranked.withColumn("is_test", F.col("rank") < F.round(F.col("total_rank") * test_share)).drop("rank", "total_rank")


def random_split(df: DataFrame, key: str, test_share: float, seed: int = 0) -> DataFrame:
    """df with is_test: that share of all rows, rounded up to whole rows, in the order of a hash of key; labels aren't looked at."""
    if not 0 < test_share < 1:
        raise ValueError("test_share must lie between 0 and 1")
    ranked = shuffled_rank(df.withColumn("_all", F.lit(1)), "_all", key, seed)
    return ranked.withColumn("is_test", F.col("rank") < F.ceil(F.col("total_rank") * test_share)).drop("rank", "total_rank", "_all")
