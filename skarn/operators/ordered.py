"""Running totals, ranks and exact quantiles over an order, without one task that holds the whole order.

Rows are dealt to ranges of the order, as many as there are shuffle partitions; totals of the ranges before and a window
inside each range give exact results. A table that is read more than once on the way is staged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def ranged(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """df (staged) with _bucket: the number of the range of (groups, value) that a row is in, rising with the value."""
    keys = [*(F.col(f"`{g}`") for g in groups), F.col(value)]
    return staged(df.repartitionByRange(*keys).withColumn("_bucket", F.spark_partition_id()))


def running(df: DataFrame, groups: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df (with _bucket, in the order's direction) with <name>: the sum over all rows of the group before this one, and total_<name>.

    Rows must be unique in groups and order, or ties be of no matter.
    """
    totals = df.groupBy(*groups, "_bucket").agg(*(F.sum(c).alias(f"_t_{k}") for k, c in sums.items()))
    earlier = Window.partitionBy(*groups).orderBy("_bucket")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*groups)
    totals = totals.select(*groups, "_bucket", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums), *(F.sum(f"_t_{k}").over(every).alias(f"total_{k}") for k in sums))
    totals = totals.select(*(F.col(g).alias(f"_g_{g}") for g in groups), F.col("_bucket").alias("_g__bucket"), *(f"_b_{k}" for k in sums), *(f"total_{k}" for k in sums))
    condition = F.col("_bucket") == F.col("_g__bucket")
    for g in groups:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = df.join(F.broadcast(totals), condition)  # a row for each group and range: ranges, and one more for each further group
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumns({k: F.col(f"_b_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    return out.drop("_bucket", "_g__bucket", *(f"_g_{g}" for g in groups), *(f"_b_{k}" for k in sums))


def numbered(df: DataFrame, key: str, name: str = "row_number") -> DataFrame:
    """df with a row number from 0 in the order of key."""
    return running(ranged(df, [], key), [], [F.col(key)], {name: F.lit(1)}).drop(f"total_{name}")


def cumulative(df: DataFrame, groups: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """A row for each group and distinct value: n_<name> (sum at it), <name> (sum below it), total_<name>."""
    counted = df.groupBy(*groups, value).agg(*(F.sum(c).alias(f"n_{k}") for k, c in sums.items()))
    return running(ranged(staged(counted), groups, value), groups, [F.col(value)], {k: F.col(f"n_{k}") for k in sums})


def quantiles(df: DataFrame, groups: list[str], value: str, probabilities: list[float], weight: Column | None = None) -> DataFrame:
    """groups, probability, quantile: exact quantiles, linear between neighbours, of the values that are not null."""
    c = cumulative(df.where(F.col(value).isNotNull()), groups, value, {"n": F.lit(1) if weight is None else weight})
    return quantiles_of(c, groups, value, probabilities, "n")


def quantiles_of(c: DataFrame, groups: list[str], value: str, probabilities: list[float], name: str) -> DataFrame:
    """quantiles of values that come n_<name> times each, from the rows of cumulative."""
    wanted = F.array(*(F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col(f"total_{name}") - 1)).alias("at")) for p in probabilities))
    met = F.filter(F.flatten(F.transform(wanted, lambda w: F.array(F.struct(w["p"].alias("p"), w["at"].alias("at"), F.floor(w["at"]).alias("i")), F.struct(w["p"].alias("p"), w["at"].alias("at"), F.ceil(w["at"]).alias("i"))))), lambda w: (w["i"] >= F.col(name)) & (w["i"] < F.col(name) + F.col(f"n_{name}")))
    rows = c.where(F.col(f"n_{name}") > 0).select(*groups, value, F.explode(met).alias("w"))
    near = rows.groupBy(*groups, F.col("w.p").alias("probability"), F.col("w.at").alias("at")).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return near.select(*groups, "probability", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("quantile"))
