"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a numeric string may look like; Spark's own cast also takes a trailing d or f.
NUMERIC_TEXT = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf|infinity)\s*$"


def numeric(column: Column, kind: T.DataType) -> Column:
    """The column as double; null for null, NaN and text that is no number."""
    if isinstance(kind, T.StringType):
        column = F.when(F.lower(column).rlike(NUMERIC_TEXT), column.try_cast("double"))
    elif isinstance(kind, T.BooleanType):
        column = column.cast("int").cast("double")
    else:
        column = column.cast("double")
    return F.nullif(column, F.lit(float("nan")))


def is_missing(column: Column, kind: T.DataType) -> Column:
    return column.isNull() | F.isnan(column) if isinstance(kind, (T.DoubleType, T.FloatType)) else column.isNull()


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def psi_term(current: Column, reference: Column, epsilon: float) -> Column:
    """One bin's part of the population stability index; only exact zeros are replaced."""
    c, r = (F.when(x == 0, F.lit(epsilon)).otherwise(x) for x in (current, reference))
    return (c - r) * F.ln(c / r)


def poisson(uniform: Column, mean: float, most: int = 20) -> Column:
    """Inverse distribution function of a Poisson variable."""
    import math

    out, cumulative = F.lit(most), 1.0
    for k in range(most - 1, -1, -1):
        cumulative = sum(math.exp(-mean) * mean**j / math.factorial(j) for j in range(k + 1))
        out = F.when(uniform < cumulative, k).otherwise(out)
    return out


def choice(uniform: Column, options: list[tuple[object, float]]) -> Column:
    """A weighted choice by cumulative weight."""
    total, cumulative, out = sum(w for _, w in options), 0.0, None
    for value, weight in options[:-1]:
        cumulative += weight / total
        out = F.when(uniform < cumulative, value) if out is None else out.when(uniform < cumulative, value)
    return out.otherwise(options[-1][0]) if out is not None else F.lit(options[-1][0])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
