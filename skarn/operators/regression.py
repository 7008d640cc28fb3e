"""Linear and polynomial least squares, and gradient descent, from sums that one aggregation gives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import regression as regression_metrics
from .preprocess import random_split
from .staging import staged


def simple(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, r2 of the least-squares line."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def polynomial(df: DataFrame, x: str, y: str, degree: int) -> np.ndarray:
    """Coefficients from the constant up; x is centred and scaled for the sums, which one aggregation gives."""
    m, s = df.agg(F.avg(x), F.stddev_pop(x)).first()
    if m is None:
        raise ValueError("no rows to fit")
    s = s or 1.0
    z = (F.col(x) - F.lit(m)) / F.lit(s)
    sums = df.agg(*(F.sum(z**k).alias(f"z{k}") for k in range(2 * degree + 1)), *(F.sum(z**k * F.col(y)).alias(f"y{k}") for k in range(degree + 1))).first()
    left = np.array([[sums[f"z{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    fit = np.linalg.lstsq(left, np.array([sums[f"y{k}"] for k in range(degree + 1)]), rcond=None)[0]
    out = np.zeros(degree + 1)
    for k, c in enumerate(fit):
        out[: k + 1] += c * np.poly1d([1 / s, -m / s]).__pow__(k).coeffs[::-1] if k else np.array([c])
    return out


def predict(df: DataFrame, x: str, coefficients, name: str = "predicted") -> DataFrame:
    out = F.lit(0.0)
    for c in reversed(list(coefficients)):
        out = out * F.col(x) + F.lit(float(c))
    return df.withColumn(name, out)


def grid(spark, low: float, high: float, points: int, coefficients) -> DataFrame:
    """x, predicted on evenly spaced points, both ends included."""
    xs = spark.range(points).select((F.lit(low) + F.col("id") * F.lit((high - low) / max(1, points - 1))).alias("x"))
    return predict(xs, "x", coefficients)


def gradient_descent(df: DataFrame, x: str, y: str, rate: float = 0.01, epochs: int = 1000) -> DataFrame:
    """epoch, w, b, loss: batch descent from 0; loss is that of the parameters before the epoch's step.

    The gradients need six sums of the data alone, so the epochs run on these and not on the rows.
    """
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.agg(F.count("*").alias("n"), F.avg(u).alias("x"), F.avg(v).alias("y"), F.avg(u * u).alias("xx"), F.avg(u * v).alias("xy"), F.avg(v * v).alias("yy")).first()
    rows, w, b = [], 0.0, 0.0
    for epoch in range(epochs if s.n else 0):
        loss = w * w * s.xx + 2 * w * b * s.x + b * b - 2 * w * s.xy - 2 * b * s.y + s.yy
        dw, db = 2 * (w * s.xx + b * s.x - s.xy), 2 * (w * s.x + b - s.y)
        w, b = w - rate * dw, b - rate * db
        rows.append((epoch, w, b, loss))
    return df.sparkSession.createDataFrame(rows, "epoch int, w double, b double, loss double")


def held_out(df: DataFrame, key: str, x: str, y: str, degree: int, test_share: float = 0.2, seed: int = 0) -> tuple[list[float], DataFrame]:
    """Coefficients of a polynomial fitted on a plain random split, and its metrics on the rows held out."""
    split = staged(random_split(df, key, test_share, seed))
    fit = [float(c) for c in polynomial(split.where("not is_test"), x, y, degree)]
    return fit, regression_metrics(predict(split.where("is_test"), x, fit), y, "predicted")
