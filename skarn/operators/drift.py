"""Distribution drift between a reference and a current table: PSI, KS, chi-square, status.

All features of a kind go through each step together, in long form (feature, value, is_reference).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.functions.columns import numeric, psi_term

from .ordered import cumulative, quantiles_of
from .staging import staged

BINS, EPSILON = 10, 1e-4


@dataclass
class DriftConfig:
    """numeric and categorical map a feature to its thresholds: psi_warn, psi_fail, ks_fail."""

    numeric: dict[str, dict] = field(default_factory=dict)
    categorical: dict[str, dict] = field(default_factory=dict)
    bins: int = BINS
    epsilon: float = EPSILON

    @staticmethod
    def of(config: dict) -> DriftConfig:
        options = config.get("options") or config
        return DriftConfig(dict(config.get("numeric_features") or {}), dict(config.get("categorical_features") or {}), int(options.get("n_bins", BINS)), float(options.get("epsilon", EPSILON)))


def long_numeric(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    def one(df: DataFrame, side: bool) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema}
        pairs = F.array(*(F.struct(F.lit(f).alias("feature"), numeric(F.col(f"`{f}`"), kinds[f]).alias("value")) for f in features))
        return df.select(F.explode(pairs).alias("x")).select("x.*", F.lit(side).alias("is_reference")).where("value is not null")

    return one(reference, True).unionByName(one(current, False))


def long_categorical(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    def one(df: DataFrame, side: bool) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("string").alias("value")) for f in features))
        return df.select(F.explode(pairs).alias("x")).select("x.*", F.lit(side).alias("is_reference")).where("value is not null")

    return one(reference, True).unionByName(one(current, False))


def _sides() -> dict[str, Column]:
    return {"ref": F.when(F.col("is_reference"), 1).otherwise(0), "cur": F.when(F.col("is_reference"), 0).otherwise(1)}


def value_counts(long: DataFrame) -> DataFrame:
    """feature, value, ref, cur: the one count that all categorical statistics share."""
    return long.groupBy("feature", "value").agg(*(F.sum(c).cast("bigint").alias(k) for k, c in _sides().items()))


def value_ranks(long: DataFrame) -> DataFrame:
    """feature, value, n_ref, n_cur, and the sums below each value and in all: the one table that all numeric statistics share."""
    return staged(cumulative(long, ["feature"], "value", _sides()))


def bin_edges(ranks: DataFrame, bins: int = BINS) -> DataFrame:
    """feature, edges from value_ranks: the interior quantiles of the reference, distinct, less its least and greatest."""
    q = quantiles_of(ranks, ["feature"], "value", [i / bins for i in range(bins + 1)], "ref")
    edges = q.groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias("all"))
    return edges.select("feature", F.when(F.size("all") > 2, F.slice("all", F.lit(2), F.size("all") - 2)).otherwise(F.array().cast("array<double>")).alias("edges"))


def psi_numeric(ranks: DataFrame, bins: int = BINS, epsilon: float = EPSILON) -> DataFrame:
    """feature, psi (NaN where a side is empty), n_reference, n_current from value_ranks."""
    edges = bin_edges(ranks, bins).withColumnRenamed("feature", "_feature")
    placed = ranks.join(F.broadcast(edges), F.col("feature") == F.col("_feature"), "left")  # a row for each feature
    placed = placed.withColumn("bin", F.coalesce(F.size(F.filter("edges", lambda e: e <= F.col("value"))), F.lit(0)))
    counts = placed.groupBy("feature", "bin").agg(F.sum("n_ref").alias("ref"), F.sum("n_cur").alias("cur"))
    return _psi(counts, epsilon)


def _psi(counts: DataFrame, epsilon: float, when_empty: float = float("nan")) -> DataFrame:
    every = Window.partitionBy("feature")
    shares = counts.withColumns({f"total_{s}": F.sum(s).over(every) for s in ("ref", "cur")})
    share = lambda s: F.coalesce(F.try_divide(F.col(s).cast("double"), F.col(f"total_{s}")), F.lit(0.0))
    sums = shares.groupBy("feature").agg(F.sum(psi_term(share("cur"), share("ref"), epsilon)).alias("psi"), F.max("total_ref").alias("n_reference"), F.max("total_cur").alias("n_current"))
    if when_empty == when_empty:
        return sums
    return sums.withColumn("psi", F.when((F.col("n_reference") == 0) | (F.col("n_current") == 0), F.lit(when_empty)).otherwise(F.col("psi")))


def psi_categorical(counts: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """feature, psi, n_reference, n_current from value_counts; an empty side's shares are all 0."""
    return _psi(counts, epsilon, 0.0)


def ks(ranks: DataFrame) -> DataFrame:
    """feature, ks from value_ranks: greatest distance of the two distribution functions (NaN where a side is empty)."""
    share = lambda s: F.try_divide((F.col(s) + F.col(f"n_{s}")).cast("double"), F.col(f"total_{s}"))
    return ranks.groupBy("feature").agg(F.coalesce(F.max(F.abs(share("ref") - share("cur"))), F.lit(float("nan"))).alias("ks"))


def chi_square(counts: DataFrame) -> DataFrame:
    """feature, chi_square of the table of values by side, from value_counts."""
    every = Window.partitionBy("feature")
    t = counts.withColumns({"tr": F.sum("ref").over(every), "tc": F.sum("cur").over(every)})
    n = (F.col("tr") + F.col("tc")).cast("double")
    row = F.col("ref") + F.col("cur")
    part = lambda seen, total: F.coalesce(F.try_divide((F.col(seen) - row * F.col(total) / n) ** 2, row * F.col(total) / n), F.lit(0.0))
    return t.groupBy("feature").agg(F.sum(part("ref", "tr") + part("cur", "tc")).alias("chi_square"))


def new_categories(counts: DataFrame) -> DataFrame:
    """feature, n_new, first_new (the first five, sorted) of values that only the current side has."""
    new = counts.where("ref = 0 and cur > 0")
    ranked = new.withColumn("k", F.row_number().over(Window.partitionBy("feature").orderBy("value")))
    return ranked.groupBy("feature").agg(F.count("*").alias("n_new"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("value")))), ",").alias("first_new"))


def classify(value: Column, warn: Column | None, fail: Column | None) -> Column:
    """ok, warn or fail; bounds count as crossed; NaN and null are ok."""
    known = value.isNotNull() & ~F.isnan(value)
    out = F.when(known & (value >= fail), F.lit("fail")) if fail is not None else F.when(F.lit(False), F.lit("fail"))
    if warn is not None:
        out = out.when(known & (value >= warn), F.lit("warn"))
    return out.otherwise(F.lit("ok"))


def worst(*statuses: Column) -> Column:
    rank = lambda s: F.when(s == "fail", 2).when(s == "warn", 1).otherwise(0)
    most = F.greatest(*map(rank, statuses)) if len(statuses) > 1 else rank(statuses[0])
    return F.when(most == 2, "fail").when(most == 1, "warn").otherwise("ok")


REPORT = ("feature", "kind", "psi", "ks", "chi_square", "n_reference", "n_current", "status", "note")


def detect(reference: DataFrame, current: DataFrame, config: DriftConfig) -> DataFrame:
    """A row for each feature of the configuration, numeric first: the columns of REPORT and position."""
    spark = reference.sparkSession
    order = [*config.numeric, *config.categorical]
    there = lambda f: f in reference.columns and f in current.columns
    numeric_, categorical = [f for f in config.numeric if there(f)], [f for f in config.categorical if there(f)]
    bounds = [(i, f, *(float(x) if (x := (config.numeric.get(f) or config.categorical.get(f) or {}).get(k)) is not None else None for k in ("psi_warn", "psi_fail", "ks_fail"))) for i, f in enumerate(order)]
    limits = spark.createDataFrame(bounds, "position int, _f string, psi_warn double, psi_fail double, ks_fail double")
    nan, parts = F.lit(float("nan")), []
    if numeric_:
        ranks = value_ranks(long_numeric(reference, current, numeric_))
        named = spark.createDataFrame([(f,) for f in numeric_], "feature string")
        found = named.join(psi_numeric(ranks, config.bins, config.epsilon), "feature", "left").join(ks(ranks), "feature", "left")
        parts.append(found.select("feature", F.lit("numeric").alias("kind"), F.coalesce("psi", nan).alias("psi"), F.coalesce("ks", nan).alias("ks"), F.lit(None).cast("double").alias("chi_square"), F.coalesce("n_reference", F.lit(0)).cast("bigint").alias("n_reference"), F.coalesce("n_current", F.lit(0)).cast("bigint").alias("n_current"), F.lit(None).cast("string").alias("note")))
    if categorical:
        counts = staged(value_counts(long_categorical(reference, current, categorical)))
        named = spark.createDataFrame([(f,) for f in categorical], "feature string")
        found = named.join(psi_categorical(counts, config.epsilon), "feature", "left").join(chi_square(counts), "feature", "left").join(new_categories(counts), "feature", "left")
        note = F.when(F.col("n_new") > 0, F.concat(F.lit("new categories: "), "first_new"))
        parts.append(found.select("feature", F.lit("categorical").alias("kind"), F.coalesce("psi", F.lit(0.0)).alias("psi"), F.lit(None).cast("double").alias("ks"), F.coalesce("chi_square", nan).alias("chi_square"), F.coalesce("n_reference", F.lit(0)).cast("bigint").alias("n_reference"), F.coalesce("n_current", F.lit(0)).cast("bigint").alias("n_current"), note.alias("note")))
    lost = [(f, "numeric" if f in config.numeric else "categorical", float("nan"), None, None, 0, 0, "the feature is missing on a side") for f in order if not there(f)]
    parts.append(spark.createDataFrame(lost, "feature string, kind string, psi double, ks double, chi_square double, n_reference bigint, n_current bigint, note string").withColumn("_lost", F.lit(True)))
    out = parts[0].withColumn("_lost", F.lit(False)) if len(parts) > 1 else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p if "_lost" in p.columns else p.withColumn("_lost", F.lit(False)))
    out = out.join(F.broadcast(limits), F.col("feature") == F.col("_f"))  # a row for each feature
    status = worst(classify(F.col("psi"), F.col("psi_warn"), F.col("psi_fail")), F.when(F.col("kind") == "numeric", classify(F.col("ks"), None, F.col("ks_fail"))).otherwise("ok"))
    return out.withColumn("status", F.when(F.col("_lost"), "fail").otherwise(status)).select("position", *REPORT)


def summary(report: DataFrame) -> DataFrame:
    """n_features, n_warnings, n_failures, passed."""
    return report.agg(F.count("*").alias("n_features"), F.count_if(F.col("status") == "warn").alias("n_warnings"), F.count_if(F.col("status") == "fail").alias("n_failures")).withColumn("passed", F.col("n_failures") == 0)
