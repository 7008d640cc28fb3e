"""Batch scoring: a scorer gives each row a probability; thresholds, chunks, metrics and samples follow from it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.columns import ratio

from .ordered import numbered, quantiles
from .staging import staged


class Scorer(Protocol):
    def probability(self, df: DataFrame, name: str) -> DataFrame:
        """df with the probability of the positive class as a double column of that name."""


class ExpressionScorer:
    """A model that is a column expression or SQL text."""

    def __init__(self, expression: Column | str) -> None:
        self.expression = expression

    def probability(self, df: DataFrame, name: str) -> DataFrame:
        expression = F.expr(self.expression) if isinstance(self.expression, str) else self.expression
        return df.withColumn(name, expression.cast("double"))


class PipelineScorer:
    """A fitted Spark ML pipeline with a probability vector of two classes."""

    def __init__(self, model) -> None:
        self.model = model

    def probability(self, df: DataFrame, name: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(df)
        if "probability" not in out.columns:
            raise ValueError("the model gives no probability of two classes")
        return out.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, name)


class ArrowScorer:
    """A foreign model: a function from a pandas frame of features to an array of probabilities, run on Arrow batches."""

    def __init__(self, predict: Callable) -> None:
        self.predict = predict

    def probability(self, df: DataFrame, name: str) -> DataFrame:
        from pyspark.sql import types as T

        predict, columns = self.predict, df.columns

        def run(frames):
            for frame in frames:
                got = predict(frame[columns])
                if getattr(got, "ndim", 1) == 2:
                    if got.shape[1] < 2:
                        raise ValueError("the model must give the probabilities of two classes")
                    got = got[:, 1]
                yield frame.assign(**{name: got})

        return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def score(df: DataFrame, scorer: Scorer, threshold: float = 0.5, id_column: str | None = None, drop: tuple[str, ...] = (), probability: str = "probability", prediction: str = "prediction", keep_features: bool = False) -> DataFrame:
    """id, probability, prediction (1 from the threshold on); all columns but the dropped before them with keep_features."""
    features = df.drop(*drop)
    scored = scorer.probability(features, probability).withColumn(prediction, (F.col(probability) >= F.lit(float(threshold))).cast("int"))
    kept = features.columns if keep_features else [c for c in (id_column,) if c and c in features.columns]
    return scored.select(*kept, probability, prediction)


def chunked(df: DataFrame, key: str, chunk_size: int) -> DataFrame:
    """df with chunk: rows in the order of key, so many to a chunk, from 0; the last may be short."""
    if chunk_size < 1:
        raise ValueError("chunk_size must be 1 or more")
    return numbered(df, key).withColumn("chunk", F.floor(F.col("row_number") / chunk_size)).drop("row_number")


def chunked_as_read(df: DataFrame, chunk_size: int) -> DataFrame:
    """df with chunk: rows in the order in which their files are read, so many to a chunk, from 0."""
    return chunked(staged(df.withColumn("_read", F.monotonically_increasing_id())), "_read", chunk_size).drop("_read")


def chunk_metrics(scored: DataFrame) -> DataFrame:
    """chunk, n, positives, positive_rate, mean, std (population), p50, p95 of the probabilities of each chunk."""
    out = scored.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("prediction").cast("bigint").alias("positives"), F.avg("probability").alias("mean"), F.stddev_pop("probability").alias("std"), F.percentile("probability", F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    return out.select("chunk", "n", "positives", ratio(F.col("positives"), F.col("n")).alias("positive_rate"), "mean", "std", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))


def _summary(df: DataFrame) -> DataFrame:
    out = df.agg(F.count("*").alias("n"), F.coalesce(F.sum("prediction"), F.lit(0)).cast("bigint").alias("positives"), F.coalesce(F.avg("probability"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("probability"), F.lit(0.0)).alias("std"))
    return out.withColumn("positive_rate", ratio(F.col("positives"), F.col("n")))


def aggregate_exact(scored: DataFrame) -> DataFrame:
    """One row over all rows; the percentiles are those of all probabilities. An empty table gives zeros."""
    q = quantiles(scored, [], "probability", [0.5, 0.95])
    q = q.agg(*(F.coalesce(F.max(F.when(F.col("probability") == p, F.col("quantile"))), F.lit(0.0)).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))))
    return _summary(scored).join(F.broadcast(q))  # one row each


def aggregate_compat(scored: DataFrame) -> DataFrame:
    """As aggregate_exact, but the percentiles are the mean of the chunks' percentiles by their rows."""
    c = chunk_metrics(scored)
    n = F.sum("n")
    mean = lambda x: F.coalesce(F.try_divide(F.sum(F.col(x) * F.col("n")), n), F.lit(0.0))
    within = F.coalesce(F.try_divide(F.sum((F.col("std") ** 2 + F.col("mean") ** 2) * F.col("n")), n), F.lit(0.0))
    out = c.agg(F.coalesce(n, F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.sum("positives"), F.lit(0)).cast("bigint").alias("positives"), mean("mean").alias("mean"), within.alias("w"), mean("p50").alias("p50"), mean("p95").alias("p95"))
    return out.select("n", "positives", "mean", F.sqrt(F.greatest(F.col("w") - F.col("mean") ** 2, F.lit(0.0))).alias("std"), ratio(F.col("positives"), F.col("n")).alias("positive_rate"), "p50", "p95")


def sample(scored: DataFrame, key: str, rows: int) -> DataFrame:
    """The first rows in the order of key."""
    return scored.orderBy(key).limit(rows)
