import pytest
from pyspark.sql import functions as F

from skarn.operators.contracts import Contract, passed, validate

KIND = "sensor string, reading double, slot bigint"
ROWS = [("n1", -4.5, 0), ("n2", 18.25, 3), ("s1", None, 23), ("n1", 7.0, 11)]
RULES = {
    "slot": {"dtype": "int", "nullable": False, "min": 0, "max": 23},
    "reading": {"dtype": "float", "max": 45},
    "sensor": {"dtype": "str", "nullable": False, "allowed": ["n1", "n2", "s1"]},
}
CONTRACT = Contract.of({"row_count": {"min": 2}, "columns": RULES})
#: Name of a change: new columns, and the rule and number of rows it breaks.
CHANGES = {
    "nothing": ({}, None),
    "null slots": ({"slot": "nullif(slot, 3)"}, ("slot", "nullability", 1)),
    "late slots": ({"slot": "slot * 3"}, ("slot", "range.max", 2)),
    "early slots": ({"slot": "slot - 1"}, ("slot", "range.min", 1)),
    "unknown sensors": ({"sensor": "upper(sensor)"}, ("sensor", "allowed_values", 4)),
    "one more column": ({"unit": "'C'"}, ("unit", "column.unexpected", 0)),
    "slots in words": ({"slot": "'noon'"}, ("slot", "dtype", 0)),
    "slots that are nan in words": ({"slot": "'nan'"}, ("slot", "dtype", 0)),
    "half slots": ({"slot": "slot + 0.5"}, ("slot", "dtype", 0)),
    "readings that are nan": ({"reading": "double('nan')"}, None),
    "readings in words": ({"reading": "'2e1'"}, None),
}


def broken(df):
    return [(r["column"], r["rule"], r["n_offending"]) for r in validate(df, CONTRACT).collect()]


@pytest.mark.parametrize("name", CHANGES)
def test_each_change_breaks_one_rule(spark, name):
    columns, rule = CHANGES[name]
    df = spark.createDataFrame(ROWS, KIND).withColumns({c: F.expr(e) for c, e in columns.items()})
    assert broken(df) == ([rule] if rule else [])
    assert passed(validate(df, CONTRACT)) == (rule is None or rule[1] == "column.unexpected")


def test_tables_without_a_column_or_rows(spark):
    df = spark.createDataFrame(ROWS, KIND)
    assert broken(df.drop("reading")) == [("reading", "column.missing", 0)]
    assert broken(df.limit(1)) == [(None, "row_count.min", 0)]
