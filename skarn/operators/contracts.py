"""Contract validation: every rule of every column in one aggregation, and one pass for examples of bad values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions.columns import is_missing, numeric

TYPES = ("int", "float", "str", "string", "bool")
ISSUES = "column string, rule string, severity string, n_offending bigint, message string"


@dataclass
class ColumnRule:
    dtype: str | None = None
    nullable: bool = True
    min: float | None = None
    max: float | None = None
    allowed: list[str] | None = None


@dataclass
class Contract:
    columns: dict[str, ColumnRule] = field(default_factory=dict)
    least_rows: int | None = None

    @staticmethod
    def of(config: dict) -> Contract:
        """From a parsed configuration: columns (a mapping, or a list with name), row_count.min."""
        columns = config.get("columns") or {}
        if isinstance(columns, list):
            columns = {c["name"]: {k: v for k, v in c.items() if k != "name"} for c in columns}
        known = ColumnRule.__dataclass_fields__
        names = {"allowed_values": "allowed"}
        rules = {n: ColumnRule(**{names.get(k, k): v for k, v in (c or {}).items() if names.get(k, k) in known}) for n, c in columns.items()}
        return Contract(rules, (config.get("row_count") or {}).get("min"))


def _wrong_type(c: Column, kind: T.DataType, dtype: str) -> Column:
    """How many values don't have the declared type."""
    present = ~is_missing(c, kind)
    if dtype in ("int", "float"):
        if isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)):
            value = numeric(c, kind)
            bad = present & value.isNull()
            if dtype == "int":
                bad = bad | present & (F.abs(value) == F.lit(float("inf"))) | present & (value % 1 != 0)
            return F.count_if(F.coalesce(bad, F.lit(False)))
        return F.count_if(present)
    fits = isinstance(kind, T.StringType) if dtype in ("str", "string") else isinstance(kind, T.BooleanType)
    return F.lit(0).cast("bigint") if fits else F.count_if(present)


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """The issues of df: column, rule, severity, n_offending, message. Missing and unexpected columns are sorted."""
    spark, kinds = df.sparkSession, {f.name: f.dataType for f in df.schema}
    missing = [(c, "column.missing", "error", 0, f"column {c} is declared and not there") for c in sorted(set(contract.columns) - set(kinds))]
    extra = [(c, "column.unexpected", "warning", 0, f"column {c} is there and not declared") for c in sorted(set(kinds) - set(contract.columns))]
    unknown, counts, checks, listed = [], {}, [], []
    if contract.least_rows is not None:
        checks.append((None, "row_count.min", F.col("n"), F.col("n") < contract.least_rows, F.lit(0), F.concat(F.col("n").cast("string"), F.lit(f" rows, at least {contract.least_rows} wanted"))))
    for number, (name, rule) in enumerate(contract.columns.items()):
        if name not in kinds:
            continue
        c, kind, key = F.col(f"`{name}`"), kinds[name], f"c{number}"
        if rule.dtype is not None and rule.dtype not in TYPES:
            unknown.append((name, "dtype.unknown", "error", 0, f"type {rule.dtype} is not supported"))
            continue

        def add(kind_of: str, counted: Column, message: str, only: Column | None = None, key=key, name=name) -> None:
            at = f"{key}_{kind_of.replace('.', '_')}"
            counts[at] = counted
            failed = F.col(at) > 0
            checks.append((name, kind_of, F.col(at), failed if only is None else failed & only, F.lit(0) if kind_of == "dtype" else F.col(at), F.concat(F.col(at).cast("string"), F.lit(f" {message}"))))

        if not rule.nullable:
            add("nullability", F.count_if(is_missing(c, kind)), "missing values where none may be")
        if rule.dtype is None:
            continue
        add("dtype", _wrong_type(c, kind, rule.dtype), f"values are no {rule.dtype}")
        typed = F.col(f"{key}_dtype") == 0
        if rule.dtype in ("int", "float"):
            value = numeric(c, kind) if isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)) else F.lit(None).cast("double")
            if rule.min is not None:
                add("range.min", F.count_if(F.coalesce(value < float(rule.min), F.lit(False))), f"values below {rule.min}", typed)
            if rule.max is not None:
                add("range.max", F.count_if(F.coalesce(value > float(rule.max), F.lit(False))), f"values above {rule.max}", typed)
        elif rule.dtype in ("str", "string") and rule.allowed is not None:
            text = c if isinstance(kind, T.StringType) else c.cast("string")
            bad = F.coalesce(~text.isin([str(v) for v in rule.allowed]), F.lit(False)) if rule.allowed else text.isNotNull()
            add("allowed_values", F.count_if(bad), "values outside the allowed", typed)
            listed.append((name, F.when(bad, text)))
    one = df.agg(F.count("*").alias("n"), *(v.alias(k) for k, v in counts.items()))
    issues = F.array(*(F.when(failed, F.struct(F.lit(name).alias("column"), F.lit(rule).alias("rule"), F.lit("error").alias("severity"), shown.cast("bigint").alias("n_offending"), message.alias("message"))) for name, rule, _, failed, shown, message in checks)) if checks else None
    fixed = spark.createDataFrame(missing + extra + unknown, ISSUES)
    if issues is None:
        return fixed
    found = one.select(F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i")).select("i.*")
    if listed:
        values = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("_column"), b.alias("value")) for n, b in listed))).alias("x")).select("x.*").where("value is not null").groupBy("_column", "value").agg(F.lit(1).alias("one"))
        first = values.withColumn("k", F.row_number().over(Window.partitionBy("_column").orderBy("value"))).where("k <= 5")
        first = first.groupBy("_column").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("_examples"))
        found = found.join(first, (F.col("column") == F.col("_column")) & (F.col("rule") == "allowed_values"), "left")
        found = found.withColumn("message", F.when(F.col("_examples").isNotNull(), F.concat("message", F.lit(": "), "_examples")).otherwise(F.col("message"))).drop("_column", "_examples")
    return found.unionByName(fixed)


def passed(issues: DataFrame) -> bool:
    return issues.where("severity = 'error'").isEmpty()
