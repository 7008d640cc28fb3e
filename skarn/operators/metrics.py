"""Classification and regression metrics as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.functions.columns import ratio

from .ordered import cumulative


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("int")
    return cumulative(df.select(F.col(score).cast("double").alias("score"), y.alias("y")), [], "score", {"pos": F.col("y"), "neg": 1 - F.col("y")})


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """roc_auc: the chance that a positive scores above a negative, half for ties; null without both."""
    c = _by_score(df, label, score)
    won = F.sum(F.col("n_pos") * (F.col("neg") + F.col("n_neg") / 2))
    return c.agg(F.try_divide(won, F.max(F.col("total_pos").cast("double") * F.col("total_neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """average_precision: precision at every score that has positives, by its share of them."""
    c = _by_score(df, label, score)
    above = F.col("total_pos") - F.col("pos")
    precision = above / (above + F.col("total_neg") - F.col("neg"))
    return c.where("n_pos > 0").agg(F.sum(F.col("n_pos") / F.col("total_pos") * precision).alias("average_precision"))


def threshold_suite(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """n, accuracy, precision, recall, f1 (0 where a denominator is), positive_rate (of labels), threshold."""
    y, p = F.col(label).cast("int"), (F.col(score) >= F.lit(float(threshold))).cast("int")
    t = df.select(y.alias("y"), p.alias("p")).agg(F.count("*").alias("n"), *(F.coalesce(F.count_if(c), F.lit(0)).alias(n) for n, c in (("tp", (F.col("y") == 1) & (F.col("p") == 1)), ("fp", (F.col("y") == 0) & (F.col("p") == 1)), ("fn", (F.col("y") == 1) & (F.col("p") == 0)))), F.avg("y").alias("positive_rate"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select("n", ratio(F.col("n") - F.col("fp") - F.col("fn"), F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), "positive_rate", F.lit(float(threshold)).alias("threshold"))


def confusion(df: DataFrame, label: str, prediction: str, classes: list[int]) -> DataFrame:
    """label, prediction, n for every pair of classes, 0 where no row is."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], "label int, prediction int")
    counts = df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["label", "prediction"], "left").fillna(0, ["n"])


def regression(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """n, mse, rmse, r2 (null if y is constant)."""
    error = (F.col(y) - F.col(predicted)) ** 2
    out = df.agg(F.count("*").alias("n"), F.avg(error).alias("mse"), F.var_pop(y).alias("v"))
    return out.select("n", "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide("mse", "v")).alias("r2"))


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))
