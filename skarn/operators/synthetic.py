"""Synthetic tables from spark.range: churn rows, and points on a line or a cubic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.columns import choice, clip, poisson, sigmoid

from .ordered import quantiles

NUMERIC = ("tenure_months", "monthly_charges", "total_charges", "num_support_tickets")
CATEGORICAL = ("contract_type", "payment_method", "internet_service", "has_phone_service", "paperless_billing")
TARGET = "churn"


# Shares of the categories.
SHARES = {
    "contract_type": {"Month-to-month": 0.55, "One year": 0.25, "Two year": 0.20},
    "payment_method": {"Electronic check": 0.25, "Mailed check": 0.25, "Bank transfer": 0.25, "Credit card": 0.25},
    "internet_service": {"DSL": 0.35, "Fiber optic": 0.45, "None": 0.20},
    "has_phone_service": {"Yes": 0.9, "No": 0.1},
    "paperless_billing": {"Yes": 0.6, "No": 0.4},
}
# Mean, deviation, least and greatest of the normal draws; mean of the tickets; range of the billing factor.
TENURE, MONTHLY, TICKETS, BILLING = (32, 24, 0, 72), (65, 30, 18, 120), 1.2, (0.9, 1.05)
# What each adds to the logit of churn.
CONTRACT_RISK = {"Month-to-month": 1.4, "One year": -0.3, "Two year": -1.2}
TENURE_RISK, CHARGE_RISK, TICKET_RISK, FIBER_RISK, NOISE = -0.025, 0.012, 0.18, 0.5, 0.6


def churn(spark: SparkSession, rows: int = 5000, churn_rate: float = 0.27, seed: int = 42) -> DataFrame:
    """Customers whose logit of churn is a sum of the risks; shifted so that about churn_rate of them have a positive one."""
    draws = iter(range(31 * seed, 31 * seed + 31))
    uniform, normal = lambda: F.rand(next(draws)), lambda mean, deviation, low, high: clip(F.randn(next(draws)) * deviation + mean, low, high)
    categories = [choice(uniform(), list(shares.items())).alias(name) for name, shares in SHARES.items()]
    df = spark.range(rows).select(
        F.col("id").alias("customer_id"), *categories, normal(*TENURE).cast("bigint").alias("tenure_months"), F.round(normal(*MONTHLY), 2).alias("monthly_charges"),
        poisson(uniform(), TICKETS).cast("bigint").alias("num_support_tickets"), (uniform() * (BILLING[1] - BILLING[0]) + BILLING[0]).alias("_billing"), (F.randn(next(draws)) * NOISE).alias("_noise"), uniform().alias("_u"),
    )
    risks = [
        F.element_at(F.create_map(*(F.lit(x) for pair in CONTRACT_RISK.items() for x in pair)), F.col("contract_type")),
        F.col("tenure_months") * TENURE_RISK, (F.col("monthly_charges") - MONTHLY[0]) * CHARGE_RISK, F.col("num_support_tickets") * TICKET_RISK, (F.col("internet_service") == "Fiber optic").cast("int") * FIBER_RISK, F.col("_noise"),
    ]
    df = df.withColumns({"total_charges": F.round(F.col("monthly_charges") * F.greatest("tenure_months", F.lit(1)) * F.col("_billing"), 2), "_logit": sum(risks[1:], risks[0])})
    cut = quantiles(df, [], "_logit", [1 - churn_rate]).select(F.col("quantile").alias("_cut"))
    df = df.join(F.broadcast(cut))  # one row
    return df.withColumn(TARGET, (F.col("_u") < sigmoid(F.col("_logit") - F.col("_cut"))).cast("int")).select("customer_id", *NUMERIC, *CATEGORICAL, TARGET)


def line(spark: SparkSession, rows: int = 100, slope: float = 3.0, intercept: float = 7.0, noise: float = 2.0, seed: int = 42) -> DataFrame:
    """x evenly in [-5, 5), y on a line with normal noise."""
    x = F.col("id") * F.lit(10.0 / rows) - 5
    return spark.range(rows).select(x.alias("x"), (slope * x + intercept + noise * F.randn(seed)).alias("y"))


def cubic(spark: SparkSession, rows: int = 15, offset: float = 0.0) -> DataFrame:
    """x evenly in [-2, 2), y = x^3 + offset."""
    x = F.col("id") * F.lit(4.0 / rows) - 2
    return spark.range(rows).select(x.alias("x"), (x**3 + offset).alias("y"))
